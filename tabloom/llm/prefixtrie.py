"""Prefix trie of conversations, with totals per subtree by depth bands.

A prefix of d turns is known by its depth and two 64-bit exclusive-or sums of hashes over (place,
role, text): a node of the trie. Sums run within blocks of a conversation and are offset by the
blocks before, so a conversation of any length is split. Depths are cut into bands of fixed
height. A node's figures go to its ancestors within its band only; then the totals of band roots,
completed from the deepest band upwards, go to their parent's ancestors within the band above.
That takes one round per band and at most `height` rows per node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import duckdb_crc32, text_or_empty, written
from tabloom.llm.places import placed

#: Least band height; deeper tries take the power of two above the root of their depth, so rounds stay as few as rows per node.
HEIGHT = 32
#: Turns of a conversation in one block, a multiple of every height.
BLOCK = 4096
#: Conversations that share their first turns, and of how many turns at most.
SHARED, TURNS = 5, 9
#: Ids that are joined into one piece of text before a node's list is hashed.
PIECE = 512
NODE = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(c, place, total, d1, d2, size): turns in order, with hashes of role and text and the text's bytes."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), text.alias("text"),
        F.xxhash64(role, text).alias("d1"), F.xxhash64(text, F.lit("turn"), role).alias("d2"), F.octet_length(text).cast("long").alias("size"),
    )
    return placed(rows, ["c"], ["turn", "role", "text"], "trie-turns", without=("turn", "role", "text"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(c, depth, length, d1, d2, size): the rebuilt conversations, each with a turnless row of depth 0."""
    first = turns.where("place = 0").select("c", "total")
    base = F.col("c") - F.pmod("c", F.lit(SHARED))
    taken = F.crc32(F.col("c").cast("string").cast("binary")) % TURNS
    convs = first.select("c", base.alias("base"), taken.alias("h"), F.col("total").alias("n"))
    convs = convs.join(first.select(F.col("c").alias("base"), F.col("total").alias("base_n")), "base", "left")
    shared = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = written(convs.select("c", "base", "h", "n", shared.alias("k"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    heads = turns.where((F.col("place") < TURNS - 1) & (F.pmod("c", F.lit(SHARED)) == 0)).select(F.col("c").alias("base"), "place", "d1", "d2", "size")
    taken_over = convs.where("k > 0").join(heads, "base").where("place < h").select("c", (F.col("place") + 1).alias("depth"), "length", "d1", "d2", "size")
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))))
    own = turns.withColumn("block", F.floor(F.col("place") / BLOCK)).join(blocks.select("c", "block", "h", "k", "length"), ["c", "block"]).where("place >= h")
    own = own.select("c", (F.col("k") + F.col("place") - F.col("h") + 1).alias("depth"), "length", "d1", "d2", "size")
    nothing = F.lit(0).cast("long")
    tops = convs.select("c", nothing.alias("depth"), "length", nothing.alias("d1"), nothing.alias("d2"), nothing.alias("size"))
    return taken_over.unionByName(own).unionByName(tops)


def prefixes(rows: DataFrame, height: int) -> DataFrame:
    """(c, depth, length, size, k1, k2, p1, p2, line): node keys, parents' keys, and the line of keys from the band's root to the node."""
    block = max(BLOCK, height)
    hashed = lambda x: F.when(F.col("depth") > 0, x).otherwise(F.lit(0).cast("long"))
    rows = rows.select(
        "c", "depth", "length", "size", F.floor(F.col("depth") / block).alias("block"),
        hashed(F.xxhash64("depth", "d1", "d2")).alias("e1"), hashed(F.xxhash64("d2", F.lit("prefix"), "d1", "depth")).alias("e2"),
    )
    rows = rows.repartition("c", "block")
    sums = rows.groupBy("c", "block").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("c", "block", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(x) for x in ("x1", "x2")]).where("block > 0")
    running = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = rows.select("*", F.bit_xor("e1").over(running).alias("r1"), F.bit_xor("e2").over(running).alias("r2"))
    keyed = keyed.join(offsets, ["c", "block"], "left")
    for n in "12":
        keyed = keyed.withColumn(f"k{n}", F.col(f"r{n}").bitwiseXOR(F.coalesce(f"x{n}", F.lit(0).cast("long"))))
        keyed = keyed.withColumn(f"p{n}", F.col(f"k{n}").bitwiseXOR(F.col(f"e{n}")))
    band = Window.partitionBy("c", "block", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("band", F.floor(F.col("depth") / height))
    return keyed.select("c", "depth", "length", "size", "k1", "k2", "p1", "p2", F.collect_list(F.struct("k1", "k2")).over(band).alias("line"))


def _spread(rows: DataFrame, height: int) -> DataFrame:
    """Leaves and tokens of each row added up for every node of its line."""
    lines = rows.select((F.col("depth") - F.col("depth") % height).alias("from"), "leaves", "saved", F.posexplode("line"))
    at = lines.select((F.col("from") + F.col("pos")).alias("depth"), "col.k1", "col.k2", "leaves", "saved")
    return at.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(nodes: DataFrame, height: int, deepest: int) -> DataFrame:
    """(depth, k1, k2, leaves, saved) over whole subtrees; nodes has own `leaves` and `saved`, p1, p2 and line."""
    inside = written(_spread(nodes, height), "trie-bands")
    if deepest < height:
        return inside
    roots = inside.where((F.col("depth") > 0) & (F.col("depth") % height == 0)).join(nodes.select(*NODE, "p1", "p2"), NODE)
    roots = written(roots, "trie-roots")
    ends = written(nodes.where(F.col("depth") % height == height - 1).select(*NODE, "line"), "trie-ends")
    passed, above = [], None
    for band in range(deepest // height, 0, -1):
        done = roots.where(F.col("depth") == band * height)
        if above is not None:
            more = above.select(F.col("line")[0]["k1"].alias("k1"), F.col("line")[0]["k2"].alias("k2"), "leaves", "saved")
            more = more.groupBy("k1", "k2").agg(F.sum("leaves").alias("m1"), F.sum("saved").alias("m2"))
            done = done.join(more, ["k1", "k2"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("m1", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("m2", F.lit(0)))
        sums = done.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        above = written(sums.withColumn("depth", F.lit(band * height - 1).cast("long")).join(ends, NODE), "trie-round")
        passed.append(above)
    every = passed[0]
    for more in passed[1:]:
        every = every.unionByName(more)
    both = inside.unionByName(_spread(every, height))
    return both.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the ascending, comma-joined ids c of each node.

    Ids are joined into pieces of PIECE where they lie; the digest of a node then reads its pieces
    in order, one at a time.
    """
    ranked = placed(rows.select(*NODE, "c"), NODE, ["c"], "trie-members")
    pieces = ranked.groupBy(*NODE, F.floor(F.col("place") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    pieces = pieces.select(*NODE, "piece", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string()]
        key, digest = None, None
        for batch in batches:
            found = []
            for *node, piece, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece == 0:
                    if key is not None:
                        found.append((*key, digest.hexdigest()))
                    key, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*NODE, "ends_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((*key, digest.hexdigest()), types, strict=True)], names=[*NODE, "ends_sha256"])

    return pieces.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, height: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id take no part. Turns ascend (null first), rows with one turn by role, then
    text; repeated rows are turns of their own. Null roles and texts are empty. A negative id's
    conversation shares with the multiple of five below it. Columns other than conv_id, turn, role
    and text are ignored. An empty table has no conversations and so no root.
    """
    rows = written(rebuilt(ordered_turns(conversations)), "trie-rebuilt")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    if height is None:
        height = HEIGHT
        while height * height < deepest and height < BLOCK:
            height *= 2
    members = prefixes(rows, height)
    found = members.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("size").alias("size"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("line").alias("line")
    )
    found = written(found, "trie-found")
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), "trie-nodes")
    totals = subtree_totals(nodes, height, deepest).select(*NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = end_digests(members.where("depth = length"))
    root = nodes.where("depth = 0").agg(F.min("conv_id")).first()[0]
    parents = nodes.where("depth > 0 AND n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    named = nodes.select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_children").join(totals, NODE).join(ends, NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(root).cast("long")).when(F.col("depth") > 1, F.col("parent"))
    empty = hashlib.sha256(b"").hexdigest()
    return named.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
firsts AS (SELECT c, max(p) AS n, c - (c % {SHARED} + {SHARED}) % {SHARED} AS base, {duckdb_crc32("c::VARCHAR")} % {TURNS} AS h FROM turns GROUP BY c),
convs AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS k FROM firsts a LEFT JOIN firsts b ON b.c = a.base),
rebuilt AS (
  SELECT v.c, t.p AS depth, role, text FROM convs v JOIN turns t ON t.c = v.base AND t.p <= v.h
  UNION ALL SELECT v.c, v.k + t.p - v.h, role, text FROM convs v JOIN turns t ON t.c = v.c AND t.p > v.h),
members AS (
  SELECT c, 0 AS depth, '' AS key, NULL AS parent, 0 AS size FROM convs
  UNION ALL SELECT c, depth, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY depth), ''), size FROM (
    SELECT c, depth, strlen(text) AS size,
      sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth)) AS key FROM rebuilt)),
lengths AS (SELECT c, max(depth) AS length FROM members GROUP BY c),
nodes AS (
  SELECT depth, key, any_value(parent) AS parent, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = length), '') AS ends
  FROM members JOIN lengths USING (c) GROUP BY depth, key),
children AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
below AS (
  SELECT m.depth, m.key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * nodes.size)::BIGINT AS saved_tokens
  FROM nodes LEFT JOIN children USING (depth, key) JOIN members m ON m.c = nodes.conv_id AND m.depth <= nodes.depth GROUP BY 1, 2)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN below USING (depth, key) LEFT JOIN children USING (depth, key)
LEFT JOIN nodes up ON up.depth = nodes.depth - 1 AND up.key = nodes.parent
"""
