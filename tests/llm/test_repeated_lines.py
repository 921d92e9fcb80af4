import random
import re

from pagestrata.llm import repeated_lines as R

PAGES = "body_id long, source_name string, page_key string, markdown string, line_no string, k1 string"


def brute(pages):
    keys, on, lines = {}, {}, []
    for body, source, key, text, *_ in pages:
        if None in (body, source, key):
            continue
        keys.setdefault(source, set()).add(key)
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            bare = re.sub(r"https?://\S*", " ", re.sub(r"\]\([^)]*\)", "]", line))
            words = tuple(re.findall(r"[^\W\d_]+", bare.lower()))
            if len(words) >= 3:
                on.setdefault((source, words), set()).add(key)
                lines.append((body, n, source, words))
    return {(b, n) for b, n, s, w in lines if len(on[s, w]) >= 4 and 100 * len(on[s, w]) >= 15 * len(keys[s])}


def found(spark, pages):
    rows = R.repeated_lines(spark.createDataFrame(pages, PAGES)).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_random_pages_match_brute_force(spark):
    rng = random.Random(3)
    legal = ["All rights are reserved.", "**ALL rights, are [reserved](/x/y)**", "Read more at https://a.b/c?d today friends", "Tell us (all) 12 now please", "Read more at https://a.b/c\u00a0today friends", "Two words", "Ünïcode ß lines Здесь"]
    pages = []
    for k in range(160):
        source = rng.choice(["one", "one", "one", "two", "few"])
        text = "\n".join(rng.choice(legal) if rng.random() < 0.25 else f"body {rng.choice('abcdefg')} text {k}x q{k % 9} {'z' * (k % 5 + 1)}" for _ in range(rng.randint(0, 9)))
        pages.append((k, source, f"p{k % 70}", rng.choice([text, text, text, None, ""]), "own", "own"))
    pages += [(500, None, "p", legal[0], None, None), (501, "one", None, legal[0], None, None), (None, "one", "p1", legal[0], None, None), pages[0]]
    assert found(spark, pages) == brute(pages)


def test_empty_and_long(spark):
    assert found(spark, []) == set()
    pages = [(k, "s", f"p{k}", "x " * 200_000 + "\nthe same three words\r\n") for k in range(4)]
    assert found(spark, [(*p, None, None) for p in pages]) == {(k, n) for k in range(4) for n in (0, 1)}


def test_lines_are_taken_out(spark):
    pages = spark.createDataFrame([(1, "s", "p", "a\nb\nc", None, None), (2, "s", "q", None, None, None)], PAGES)
    out = R.without_lines(pages, spark.createDataFrame([(1, 1)], "body_id long, line_no long")).orderBy("body_id").collect()
    assert [r.markdown for r in out] == ["a\nc", None]
