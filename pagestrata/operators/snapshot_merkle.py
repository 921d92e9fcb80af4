"""What changed between consecutive full snapshots, by comparing Merkle trees of hash ranges.

Each snapshot's live pages are spread over ``2**leaf_bits`` ranges of the hash of their key. A leaf's
digest is the XOR of two independently seeded 64-bit hashes of (key, content hash) plus a row count, so it
is a mergeable aggregate (map-side partial, no ordering) and an inner node's digest is the XOR of its
children. Two snapshots are compared from the root downwards; below nodes that are equal nothing is looked at.
Only the leaves whose digests differ are opened: their pages are read, and only these are joined. Digests may be
stored with the snapshots, and then nothing else of the pages is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.session import broadcast_if_small, cut

#: The characters that count as surrounding white space of a stored hash.
HASH_MARGIN = " \t\n\r\f\x0b "

ROWS_PER_LEAF = 256
FANOUT_BITS = 4


def normal_hash(column: Column) -> Column:
    """A content hash without surrounding white space, in lower case."""
    return F.lower(F.btrim(column, F.lit(HASH_MARGIN)))


def live_pages(pages: DataFrame) -> DataFrame:
    """The pages present in each snapshot: one row (source_name, snapshot_label, page_key, sha).

    Of several rows for one key the one with the latest ``fetched_at`` holds; a null ``fetched_at`` is the
    earliest, and among equal times the greater (status, hash) holds, so the result doesn't depend on row
    order. A status other than ``removed``, null included, means present. Rows with a null source, label
    or key name no page and are left out.
    """
    newest = F.max(F.struct("fetched_at", "status", normal_hash(F.col("sha256")).alias("sha"))).alias("newest")
    return (
        pages.select("source_name", "snapshot_label", "page_key", "fetched_at", "status", "sha256")
        .where("source_name IS NOT NULL AND snapshot_label IS NOT NULL AND page_key IS NOT NULL")
        .groupBy("source_name", "snapshot_label", "page_key")
        .agg(newest)
        .where(~F.col("newest.status").eqNullSafe("removed"))
        .select("source_name", "snapshot_label", "page_key", F.col("newest.sha").alias("sha"))
    )


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """Distinct (source_name, snapshot_label, previous_label) of fetched snapshots that name a predecessor."""
    return (
        snapshots.where("status = 'fetched' AND previous_snapshot_label IS NOT NULL")
        .where("source_name IS NOT NULL AND snapshot_label IS NOT NULL")
        .select("source_name", "snapshot_label", F.col("previous_snapshot_label").alias("previous_label"))
        .distinct()
    )


def leaf_bits_for(rows: int, trees: int, rows_per_leaf: int = ROWS_PER_LEAF) -> int:
    """Leaf bits, a multiple of the fan-out, that give about ``rows_per_leaf`` rows a leaf on average."""
    leaves = max(1.0, rows / max(1, trees) / rows_per_leaf)
    return min(32, FANOUT_BITS * math.ceil(math.log2(leaves) / FANOUT_BITS)) if leaves > 1 else FANOUT_BITS


def _leaf(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("page_key"), 64 - bits)


def leaf_digests(pages: DataFrame, bits: int) -> DataFrame:
    """(source_name, snapshot_label, node, d1, d2, n) of every leaf that holds a page; what is stored with snapshots."""
    return live_pages(pages).groupBy("source_name", "snapshot_label", _leaf(bits).alias("node")).agg(
        F.bit_xor(F.xxhash64("page_key", "sha")).alias("d1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "sha", "page_key")).alias("d2"),
        F.count(F.lit(1)).alias("n"),
    )


def digests_above(leaves: DataFrame, height: int) -> DataFrame:
    """The digests of the nodes ``height`` levels above the leaves, with the parent of each."""
    node = F.shiftrightunsigned("node", FANOUT_BITS * height)
    return leaves.groupBy("source_name", "snapshot_label", node.alias("node")).agg(
        F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n")
    ).withColumn("parent", F.shiftrightunsigned("node", FANOUT_BITS))


PAIR = ["source_name", "snapshot_label", "previous_label"]


def _differing(opened: DataFrame, digests: DataFrame) -> DataFrame:
    """The children of opened nodes (a pair's keys, parent) whose digests differ between the snapshots of the pair."""
    digest = F.struct("d1", "d2", "n")
    none = F.lit(None).cast("struct<d1:bigint,d2:bigint,n:bigint>")
    cur = opened.join(digests, ["source_name", "snapshot_label", "parent"]).select(*PAIR, "node", digest.alias("cur"), none.alias("prev"))
    old = digests.withColumnRenamed("snapshot_label", "previous_label")
    prev = opened.join(old, ["source_name", "previous_label", "parent"]).select(*PAIR, "node", none.alias("cur"), digest.alias("prev"))
    return (
        cur.unionByName(prev)
        .groupBy(*PAIR, "node")
        .agg(F.first("cur", ignorenulls=True).alias("cur"), F.first("prev", ignorenulls=True).alias("prev"))
        .where(~F.col("cur").eqNullSafe(F.col("prev")))
        .select(*PAIR, "node")
    )


def differing_leaves(pairs: DataFrame, leaves: DataFrame, bits: int) -> DataFrame:
    """(source_name, snapshot_label, previous_label, node) of the leaves to open, found top-down.

    Each level is written before the next one is looked at, so that only children of differing nodes are joined.
    """
    opened = pairs.select(*PAIR, F.lit(0).cast("bigint").alias("node"))
    for height in range(bits // FANOUT_BITS, -1, -1):
        opened = cut(_differing(broadcast_if_small(opened.withColumnRenamed("node", "parent")), digests_above(leaves, height)))
    return opened


def snapshot_changes(
    pages: DataFrame, snapshots: DataFrame, rows_per_leaf: int = ROWS_PER_LEAF, digests: DataFrame | None = None, bits: int | None = None
) -> DataFrame:
    """(source_name, snapshot_label, page_key, change) of each fetched snapshot against its predecessor.

    ``change`` is added, removed or changed; a page whose hash is null on either side isn't changed. A
    predecessor without any page makes every page added; a snapshot without any page makes every page of
    its predecessor removed. Empty tables give an empty result. Extra columns are ignored. ``change_status``
    isn't read. ``digests`` are stored ``leaf_digests`` of all these snapshots, made with ``bits``.
    """
    pairs = cut(snapshot_pairs(snapshots))
    labels = cut(pairs.select("source_name", "snapshot_label").union(pairs.select("source_name", "previous_label")).distinct())
    columns = ["source_name", "snapshot_label", "page_key", "fetched_at", "status", "sha256"]
    wanted = pages.select(*columns).join(broadcast_if_small(labels), ["source_name", "snapshot_label"], "left_semi")
    if digests is None:
        bits = leaf_bits_for(pages.count(), labels.count(), rows_per_leaf)
        digests = cut(leaf_digests(wanted, bits))
    opened = differing_leaves(pairs, digests, bits).withColumnRenamed("node", "leaf")

    # the two sides of each opened leaf: whose pages it holds, and in which pair
    side = lambda label, role: opened.select("source_name", F.col(label).alias("label"), "leaf", "snapshot_label", "previous_label", F.lit(role).alias("role"))
    sides = broadcast_if_small(cut(side("snapshot_label", 1).union(side("previous_label", 0))))
    read = wanted.withColumnRenamed("snapshot_label", "label").withColumn("leaf", _leaf(bits))
    in_opened = read.join(sides.select("source_name", "label", "leaf"), ["source_name", "label", "leaf"], "left_semi")
    live = live_pages(in_opened.withColumnRenamed("label", "snapshot_label")).withColumnRenamed("snapshot_label", "label").withColumn("leaf", _leaf(bits))
    keys = ["source_name", "snapshot_label", "page_key"]
    rows = live.join(sides, ["source_name", "label", "leaf"]).select(*keys, "previous_label", F.struct("role", "sha").alias("row"))
    is_now, is_before = F.col("row.role") == 1, F.col("row.role") == 0
    merged = rows.groupBy(*keys, "previous_label").agg(
        F.count_if(is_now).alias("in_now"),
        F.count_if(is_before).alias("in_before"),
        F.max(F.when(is_now, F.col("row.sha"))).alias("sha_now"),
        F.max(F.when(is_before, F.col("row.sha"))).alias("sha_before"),
    )
    change = (
        F.when(F.col("in_before") == 0, "added")
        .when(F.col("in_now") == 0, "removed")
        .when(F.col("sha_now") != F.col("sha_before"), "changed")
    )
    return merged.select(*keys, change.alias("change")).where("change IS NOT NULL").distinct()
