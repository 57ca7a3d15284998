"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and a proof for every row.

Leaves of a source are dealt to aligned partitions of `FANOUT ** LOCAL_LEVELS` consecutive ones. A
partition hashes its own subtree in one pass. The levels above come from a butterfly exchange: in
round r every partition asks, in each of the up to `FANOUT` neighbouring subtrees of
`FANOUT ** r` partitions, the partition at its own offset for that subtree's root (the last one,
where the last subtree is shorter). It then hashes their common parent itself, as all its
neighbours do. After the last round every partition holds the root and all the siblings on its
way up, and nothing has to be passed down again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import duckdb_crc32, written
from tabloom.llm.places import placed

FANOUT = 16
LOCAL_LEVELS = 3
SPAN = FANOUT**LOCAL_LEVELS
#: Of how many ids (by CRC-32) one is tampered with.
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def _digest(*values: Column) -> Column:
    """H over fields: `-` for null, else UTF-8 byte count, colon, value."""
    fields = []
    for value in values:
        held = value.cast("string")
        fields.append(F.when(held.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(held).cast("string"), F.lit(":"), held)))
    return F.sha2(F.concat(*fields), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(key, id, leaf, bent): the source's key, the leaf, and the leaf that a tampered text would have.

    The key is empty for a null source and starts with `s` otherwise, so it sorts as asked and is never null.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    rest = [doc_id, F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    tampered = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    low = F.translate(text, _UPPER, _LOWER)
    leaf = _digest(*rest, text)
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("key"),
        doc_id.alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(F.when(tampered & (low != text), _digest(*rest, low))).alias("bent"),
    )


def _levels(held: list[str], whole: bool) -> list[list[str]]:
    """Per local level the runs (digests of siblings, joined), the last of them the one below the root.

    With `whole` the partition is the whole tree and hashing stops at a single node; else all
    local levels are hashed, single nodes included.
    """
    levels = []
    while len(held) > 1 if whole else len(levels) < LOCAL_LEVELS:
        runs = ["".join(held[at : at + FANOUT]) for at in range(0, len(held), FANOUT)]
        levels.append(runs)
        held = [hashlib.sha256(run.encode()).hexdigest() for run in runs]
    return levels


def _root(held: list[str], levels: list[list[str]]) -> str:
    return hashlib.sha256(levels[-1][0].encode()).hexdigest() if levels else held[0]


def _hexes(column: pa.Array) -> list[str]:
    return [x.hex() if x is not None else "" for x in column.to_pylist()]


def partitions(rows: DataFrame, id_type: str, name: str) -> DataFrame:
    """(key, chunk, total, ids, leaves, bents, node): one row per aligned partition, with its subtree's root.

    rows (key, place, total, id, leaf, bent). The table is written: at most SPAN leaves in a row.
    """
    dealt = rows.select("key", F.floor(F.col("place") / SPAN).cast("long").alias("chunk"), "place", "total", "id", "leaf", "bent")
    dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "place").drop("place")
    schema = f"key string, chunk long, total long, ids array<{id_type}>, leaves array<binary>, bents array<binary>, node string"
    kind = pa.int64() if id_type == "long" else pa.string()
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.string()]

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        key, chunk, total = (table.column(k)[0].as_py() for k in range(3))
        ids, own, bent = (table.column(k).to_pylist() for k in range(3, 6))
        held = [x.hex() for x in own]
        node = _root(held, _levels(held, total <= SPAN))
        return pa.record_batch([pa.array([x], t) for x, t in zip((key, chunk, total, ids, own, bent, node), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_parts: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, chunks = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if open_parts and (open_parts[0].column(0)[0].as_py(), open_parts[0].column(1)[0].as_py()) != (keys[a], chunks[a]):
                    yield row(open_parts)
                    open_parts = []
                open_parts.append(batch.slice(a, b - a))
        if open_parts:
            yield row(open_parts)

    return written(dealt.mapInArrow(run, schema), name)


def butterfly(parts: DataFrame, name: str) -> DataFrame:
    """(key, chunk, node, path): every partition with its tree's root and the siblings above its own subtree.

    One round per level above the partitions. A partition receives at most FANOUT digests in a
    round; each round is a table in the shared folder.
    """
    count = F.ceil(F.col("total") / SPAN).cast("long")
    state = written(parts.select("key", "chunk", count.alias("count"), "node", F.array().cast(_PATH).alias("path")), name)
    rounds, most = 0, state.agg(F.max("count")).first()[0] or 0
    while FANOUT**rounds < most:
        size = FANOUT**rounds
        state = state.withColumn("own", F.floor(F.col("chunk") / size)).withColumn("last", F.ceil(F.col("count") / size) - 1)
        first = F.col("own") - F.col("own") % FANOUT
        asked = state.where("last > 0").select("key", "chunk", "count", F.explode(F.sequence(first, F.least(first + FANOUT - 1, F.col("last")))).alias("subtree"))
        asked = asked.withColumn("partner", F.least(F.col("subtree") * size + F.col("chunk") % size, F.col("count") - 1))
        sent = state.select("key", F.col("chunk").alias("partner"), "node")
        got = asked.join(sent, ["key", "partner"]).groupBy("key", "chunk").agg(F.array_sort(F.collect_list(F.struct("subtree", "node"))).alias("nodes"))
        both = state.join(got, ["key", "chunk"], "left")
        text = lambda keep: F.array_join(F.transform(F.filter("nodes", keep), lambda x: x["node"]), "")
        step = F.struct(text(lambda x: x["subtree"] < F.col("own")).alias("before"), text(lambda x: x["subtree"] > F.col("own")).alias("after"))
        moved = F.col("nodes").isNotNull()
        state = written(
            both.select(
                "key", "chunk", "count",
                F.when(moved, F.sha2(F.array_join(F.col("nodes.node"), ""), 256)).otherwise(F.col("node")).alias("node"),
                F.when(moved, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"),
            ), name,
        )
        rounds += 1
    return state.drop("count")


def _ways(own: int, levels: list[list[str]]) -> list[tuple[str, str]]:
    """Siblings before and after a leaf's way up, per local level."""
    way = []
    for runs in levels:
        own, digit = divmod(own, FANOUT)
        way.append((runs[own][: 64 * digit], runs[own][64 * (digit + 1) :]))
    return way


def _tops(subroots: DataFrame) -> DataFrame:
    """(key, root, top): for every source the root over all sources and the siblings on its way up."""
    rows = placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("id"), F.unhex("node").alias("leaf"), F.lit(None).cast("binary").alias("bent")), ["key"], ["id"], "merkle-sources")
    parts = partitions(rows, "string", "merkle-source-parts")
    above = butterfly(parts, "merkle-source-rounds").withColumnRenamed("node", "root")
    held = parts.select("key", "chunk", "total", "ids", "leaves").join(above, ["key", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["total", "ids", "leaves", "root", "path"]).to_pylist():
                levels = _levels([x.hex() for x in r["leaves"]], r["total"] <= SPAN)
                tops = [[{"before": a, "after": b} for a, b in _ways(k, levels)] + r["path"] for k in range(len(r["ids"]))]
                step = pa.struct([("before", pa.string()), ("after", pa.string())])
                yield pa.record_batch([pa.array(r["ids"], pa.string()), pa.array([r["root"]] * len(tops), pa.string()), pa.array(tops, pa.list_(step))], names=["key", "root", "top"])

    return held.mapInArrow(run, f"key string, root string, top {_PATH}")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    Every row is a leaf, repeated rows too; within a source leaves ascend by doc_id (null first),
    rows with one id by their digest. A null field is hashed as `-`, an empty text as `0:`. A
    row without an id is never tampered with. Columns other than doc_id, source, lang, n_chars
    and text are ignored. An empty table gives no rows.
    """
    rows = placed(leaves(docs), ["key"], ["id", "leaf"], "merkle-leaves")
    parts = partitions(rows, "long", "merkle-parts")
    above = butterfly(parts, "merkle-rounds").withColumnRenamed("node", "subroot")
    tops = _tops(above.where("chunk = 0").select("key", F.col("subroot").alias("node")))
    way = above.join(tops, "key").select("key", "chunk", "subroot", "root", F.concat("path", "top").alias("path"))
    held = parts.drop("node").join(way, ["key", "chunk"]).drop("key", "chunk")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {name: batch.column(name)[k].as_py() for name in ("total", "ids", "leaves", "bents", "subroot", "root", "path")}
                own = [x.hex() for x in r["leaves"]]
                levels = _levels(own, r["total"] <= SPAN)
                upper = [(x["before"].encode(), x["after"].encode()) for x in r["path"]]
                tail = b"".join(a + b for a, b in upper)
                proofs, folded = [], []
                for at, bent in enumerate(r["bents"]):
                    local = [(a.encode(), b.encode()) for a, b in _ways(at, levels)]
                    proofs.append(hashlib.sha256(b"".join([x for step in local for x in step]) + tail).hexdigest())
                    node = (own[at] if bent is None else bent.hex()).encode()
                    for before, after in (*local, *upper):
                        node = hashlib.sha256(before + node + after).hexdigest().encode()
                    folded.append(node.decode())
                n = len(own)
                yield pa.record_batch(
                    [pa.array(r["ids"], pa.int64()), pa.array(own), pa.array([r["subroot"]] * n), pa.array([r["root"]] * n), pa.array(proofs), pa.array(folded), pa.array([x == r["root"] for x in folded], pa.bool_())],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    return held.mapInArrow(run, schema)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest row of every document."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Levels that the SQL spells out for a source's tree and for the tree of sources.
_SQL_LEVELS, _SQL_TOP_LEVELS = 6, 4


def _sql() -> str:
    def field(name: str) -> str:
        return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"

    def tree(name: str, depth: int) -> list[str]:
        steps = []
        for k in range(depth):
            steps.append(f"{name}r{k} AS (SELECT source, i // {FANOUT} AS g, string_agg(h, '' ORDER BY i) AS run, max(n) AS n FROM {name}{k} GROUP BY 1, 2)")
            steps.append(f"{name}{k + 1} AS (SELECT source, g AS i, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h, (n + {FANOUT - 1}) // {FANOUT} AS n FROM {name}r{k})")
        return steps

    def fold(name: str, at: str, source: str, depth: int, before: str) -> list[str]:
        steps = []
        for k in range(depth):
            digit = f"({at} // {FANOUT**k} % {FANOUT})"
            first, rest = f"left(run, 64 * {digit})", f"substr(run, 64 * {digit} + 65)"
            steps.append(
                f"f{name}{k} AS (SELECT f.* EXCLUDE (proof, folded), CASE WHEN r.n > 1 THEN proof || {first} || {rest} ELSE proof END AS proof, "
                f"CASE WHEN r.n > 1 THEN sha256({first} || folded || {rest}) ELSE folded END AS folded "
                f"FROM {before} f JOIN {name}r{k} r ON r.source IS NOT DISTINCT FROM {source} AND r.g = f.{at} // {FANOUT ** (k + 1)})"
            )
            before = f"f{name}{k}"
        return steps

    rest = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    steps = [
        f"leafs AS (SELECT doc_id, source, sha256({rest} || {field('text')}) AS leaf, {rest} AS rest, text FROM documents)",
        f"bent AS (SELECT doc_id, source, leaf, CASE WHEN doc_id IS NOT NULL AND {duckdb_crc32('doc_id::VARCHAR')} % {TAMPERED} = 0 "
        f"THEN sha256(rest || coalesce(strlen(translate(text, '{_UPPER}', '{_LOWER}')) || ':' || translate(text, '{_UPPER}', '{_LOWER}'), '-')) ELSE leaf END AS folded, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leafs)",
        "d0 AS (SELECT source, i, leaf AS h, n FROM bent)",
        *tree("d", _SQL_LEVELS),
        f"subroots AS (SELECT source AS name, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j, count(*) OVER () AS n FROM d{_SQL_LEVELS})",
        "t0 AS (SELECT NULL AS source, j AS i, h, n FROM subroots)",
        *tree("t", _SQL_TOP_LEVELS),
        "start AS (SELECT bent.* EXCLUDE (n), subroots.h AS subroot, j, '' AS proof FROM bent JOIN subroots ON subroots.name IS NOT DISTINCT FROM bent.source)",
        *fold("d", "i", "f.source", _SQL_LEVELS, "start"),
        *fold("t", "j", "NULL", _SQL_TOP_LEVELS, f"fd{_SQL_LEVELS - 1}"),
    ]
    return "WITH " + ",\n".join(steps) + (
        f"\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified FROM ft{_SQL_TOP_LEVELS - 1} f, t{_SQL_TOP_LEVELS} r"
    )


OP12_SQL = _sql()
