import random
import time

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from pagestrata.operators import chunk, normalize
from pagestrata.operators.ranks import with_row_number
from pagestrata.plans.normalize_sql import NORMALIZED_SQL
from pagestrata.session import broadcast_if_small


def test_row_numbers_match_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, *range(5)]), k) for k in range(400)]
    frame = spark.createDataFrame(rows, "g string, v int, id long")
    out = {r.id: r.n for r in with_row_number(frame, ["g"], ["v", "id"], "n").collect()}
    for g in (None, "a", "b"):
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [out[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))
    assert with_row_number(frame.limit(0), ["g"], ["v", "id"], "n").count() == 0


def test_small_sides_are_broadcast(spark):
    side = spark.createDataFrame([("a", [1, 2]), (None, None)], "k string, v array<long>")
    assert "hint" in broadcast_if_small(side)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in broadcast_if_small(side, 10)._jdf.queryExecution().logical().toString().lower()
    assert broadcast_if_small(side.limit(0)).count() == 0


def plain_packs(words, target, overlap):
    """Block by block, as the rule is worded."""
    out, s = [], 0
    while s < len(words):
        e, held = s, 0
        while e < len(words) and (e == s or held < target):
            held += max(1, words[e])
            e += 1
        out.append((s, e))
        if e == len(words):
            break
        back, shared = e - 1, max(1, words[e - 1])
        while back > s and shared < overlap:
            back -= 1
            shared += max(1, words[back])
        s = e if back == s else back
    return out


def test_packs_match_the_rule():
    rng = random.Random(2)
    for _ in range(400):
        words = [rng.choice([0, 1, 3, 9, 40]) for _ in range(rng.randrange(30))]
        target, overlap = rng.randrange(1, 40), rng.randrange(0, 50)
        assert chunk.pack(words, target, overlap) == plain_packs(words, target, overlap)


def test_a_section_of_many_blocks(spark):
    text = "# T\n\n" + "\n\n".join(f"word{k} and some more words" for k in range(10_000))
    began = time.monotonic()
    rows = chunk.chunk_pages(spark.createDataFrame([("p", text)], "page_key string, markdown string"), ["page_key"], target_words=20, overlap_words=4)
    assert rows.count() > 2000 and time.monotonic() - began < 40


LINES = """> ## Documentation Index|> see llms.txt|# Title|# Title|## Title|text|    indented|\tcode|<Info>|</Info>|<Tabs>|</Tabs>|<Tab title="A">|</Tab>|<TabItem value="b" label="B">|</TabItem>|<Card title="C" href="/c">|</Card>
<VPCard desc="d" text="t" />|<Details summary="s">|</Details>|<Callout type="danger">|</Callout>|<details>|<summary> Sum </summary>|</details>|{% hint style="info" %}|{% hint type="x-y" title="Z" %}|{% endhint %}|{% tabs %}|{% tab %}|{% tab title="q" %}|{% endtab %}
!!! note|!!! tip "T"|??? own_kind 'x'|??? danger|=== "Py"|=== 'Q'|import a from "b";|import a|export const x = 1|{/* c */}|<!-- c -->|<img src="x"/>|a <img src="x"/> b|a <Tooltip x="1">tip</Tooltip> b|<Badge text="x" />|<Badge>|</Badge>|<VPBadge x />
x <Badge text="x" /> y|<Unknown a="b">|</Unknown>|<Unknown/> tail|```js title="a"|```js|```|~~~|<Step>|<Step title="1">|</Step>|<Accordion title=" ">|  <Note>|</Note>  |<p>html</p>|\u00a0|\u3000# Title\u2003|""".replace("\n", "|").split("|")


def test_random_pages_against_the_rules_in_sql(spark):
    rng = random.Random(5)
    pages = [(k, rng.choice(["\n", "\n", "\r\n"]).join(rng.choice(LINES) for _ in range(rng.randrange(14)))) for k in range(700)]
    pages += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "> ## Documentation Index\n> llms.txt\n"), (1004, "\n\n> ## Documentation Index\n\n> llms.txt\n\n\n\nx"), (1005, "x" * 200_000 + "\n" * 5 + "y")]
    frame = spark.createDataFrame(pages, "body_id long, markdown string")
    rows = normalize.normalize_pages(frame, ["body_id"])
    mine = rows.withColumn("profiles_applied", F.array_join("profiles_applied", ",")).withColumn("markdown", F.sha2("markdown", 256)).toPandas()
    with duckdb.connect() as held:
        page_bodies = frame.toPandas()  # noqa: F841  read by its name
        theirs = held.execute(NORMALIZED_SQL).fetch_df()
    columns = sorted(mine.columns)
    text = lambda df: {r[0]: tuple(None if pd.isna(v) else str(v) for v in r) for r in df[["body_id", *[c for c in columns if c != "body_id"]]].itertuples(index=False, name=None)}
    a, b = text(mine), text(theirs)
    assert [(k, dict(pages)[k], a[k], b[k]) for k in a if a[k] != b[k]][:3] == [] and a.keys() == b.keys()
