import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagestrata.operators import snapshot_merkle as M

PAGES = "source_name string, snapshot_label string, page_key string, fetched_at timestamp, status string, sha256 string, change_status string, leaf string"
SNAPSHOTS = "source_name string, snapshot_label string, previous_snapshot_label string, status string"
T0 = datetime(2024, 1, 1)


def brute(pages, snapshots):
    newest = {}
    for source, label, key, at, status, sha, *_ in pages:
        if None in (source, label, key):
            continue
        sha = sha.strip().lower() if sha is not None else None
        rank = (at is not None, at or T0, status is not None, status or "", sha is not None, sha or "")
        if (source, label, key) not in newest or rank > newest[source, label, key][0]:
            newest[source, label, key] = (rank, status, sha)
    live = {}
    for (source, label, key), (_, status, sha) in newest.items():
        if status != "removed":
            live.setdefault((source, label), {})[key] = sha
    out = set()
    for source, label, previous, status in snapshots:
        if status != "fetched" or previous is None or source is None or label is None:
            continue
        now, before = live.get((source, label), {}), live.get((source, previous), {})
        out |= {(source, label, k, "added") for k in now if k not in before}
        out |= {(source, label, k, "removed") for k in before if k not in now}
        out |= {(source, label, k, "changed") for k in now if k in before and None not in (now[k], before[k]) and now[k] != before[k]}
    return out


def found(spark, pages, snapshots, **kw):
    rows = M.snapshot_changes(spark.createDataFrame(pages, PAGES), spark.createDataFrame(snapshots, SNAPSHOTS), **kw).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("seed,rows_per_leaf", [(1, 4), (2, 256)])
def test_random_snapshots_match_brute_force(spark, seed, rows_per_leaf):
    rng = random.Random(seed)
    pages = []
    for source in "ab":
        for label in ("v1", "v2", "v10"):
            for k in range(120):
                for _ in range(rng.choice([0, 1, 1, 1, 2])):
                    sha = rng.choice([None, f"h{k}", f" H{k}\n", f"h{k}x", f"h{k}"])
                    at = rng.choice([None, T0 + timedelta(hours=rng.randint(0, 3))])
                    pages.append((source, label, f"p{k}", at, rng.choice(["stored", "stored", "removed", None]), sha, "new", "own column"))
    pages += [(None, "v1", "p", T0, "stored", "x", None, None), ("a", "v1", None, T0, "stored", "x", None, None)]
    snapshots = [(s, b, a, "fetched") for s in "ab" for a, b in (("v1", "v2"), ("v2", "v10"), ("v0", "v1"))]
    snapshots += [snapshots[0], ("a", "v3", "v10", "fetched"), ("b", "v9", "v1", "scaffolded"), ("b", "v8", None, "fetched")]
    assert found(spark, pages, snapshots, rows_per_leaf=rows_per_leaf) == brute(pages, snapshots)


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [], [("a", "v2", "v1", "fetched")]) == set()


def test_only_differing_leaves_are_opened(spark):
    pages = [("a", label, f"p{k}", T0, "stored", f"h{k}", None, None) for label in ("v1", "v2") for k in range(300)]
    rows = spark.createDataFrame(pages, PAGES)
    pairs = M.snapshot_pairs(spark.createDataFrame([("a", "v2", "v1", "fetched")], SNAPSHOTS))
    assert M.differing_leaves(pairs, M.leaf_digests(rows, 8), 8).count() == 0
    changed = rows.withColumn("sha256", F.when((F.col("page_key") == "p7") & (F.col("snapshot_label") == "v2"), "other").otherwise(F.col("sha256")))
    assert M.differing_leaves(pairs, M.leaf_digests(changed, 8), 8).count() == 1


def test_stored_digests_decide_what_is_read(spark):
    pages = [("a", label, f"p{k}", T0, "stored", f"h{k}{label if k == 7 else ''}", None, None) for label in ("v1", "v2") for k in range(300)]
    stored = M.leaf_digests(spark.createDataFrame(pages, PAGES), 8)
    snapshots = spark.createDataFrame([("a", "v2", "v1", "fetched")], SNAPSHOTS)
    # pages of leaves that are equal by their stored digests aren't looked at again
    later = [(s, label, key, at, status, sha if key in ("p7", "p8") else sha + label, c, x) for s, label, key, at, status, sha, c, x in pages]
    out = M.snapshot_changes(spark.createDataFrame(later, PAGES), snapshots, digests=stored, bits=8)
    assert {tuple(r) for r in out.where("page_key = 'p7'").collect()} == {("a", "v2", "p7", "changed")} and out.count() < 10
