"""SimHash near-duplicates: segment bit counts, grid join under Manhattan distance, exact check.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints. Counts are
written in unary (0, 1, 2 -> 00, 01, 11), so that the Manhattan distance is the number of
differing bits of two codes, and a grid cell over some segments is the code under a mask.

The segments are dealt to `GROUPS` groups. If two vectors lie within `threshold`, at most that
many groups differ, so all the other groups agree: the range join becomes an equality join on
the cells of every choice of `GROUPS - threshold` groups. Nothing within reach is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import connected_components, text_or_empty, written

THRESHOLD = 4
WIDTH = 4
GROUPS = 7
_LOW_BITS = 0x5555555555555555
_SMALL_CELL = 8


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """SimHash of word shingles hashed by XXH64 with seed 42; a text without words has zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    count = max(1, len(words) - width + 1)
    ends = ends[min(width, len(words)) - 1 :] - 1
    votes = np.zeros(64, np.int64)
    for at in range(0, count, 65536):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : min(count, at + 65536)].tolist(), ends[at : at + 65536].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp) for every row; a null text counts as an empty one."""
    source = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=[id_col, "fp"])

    return source.mapInArrow(run, f"{id_col} long, fp long")


def _unary(prints: np.ndarray) -> np.ndarray:
    low, one = np.uint64(_LOW_BITS), np.uint64(1)
    return ((prints | (prints >> one)) & low) | ((prints & (prints >> one) & low) << one)


def _near(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs lie within `threshold` bits: the Manhattan bound first, then exactly."""
    close = np.bitwise_count(_unary(a) ^ _unary(b)) <= threshold
    at = np.flatnonzero(close)
    close[at] = np.bitwise_count((a[at] if len(a) == len(b) else a) ^ b[at]) <= threshold
    return close


def _reach(prints: np.ndarray, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links that span the components of one large cell: what was reached is not compared again."""
    left = prints
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            seen = _near(np.array([front.pop()], np.uint64), left, threshold)
            if seen.any():
                found = left[seen]
                yield root, found
                front.extend(found)
                left = left[~seen]


def _cell_links(table: pa.Table, threshold: int) -> pa.RecordBatch:
    """Links between the fingerprints of whole cells that lie together."""
    grid, cell, prints = (table.column(k).to_numpy() for k in ("grid", "cell", "fp"))
    prints = prints.view(np.uint64)
    cut = np.flatnonzero((grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])) + 1
    first = np.concatenate(([0], cut))
    sizes = np.diff(np.concatenate((first, [len(grid)])))
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= _SMALL_CELL), sizes)
    run, few = np.repeat(np.arange(len(sizes)), sizes)[small], prints[small]
    for lag in range(1, _SMALL_CELL):
        at = np.flatnonzero(run[lag:] == run[:-lag])
        if not len(at):
            break
        at = at[_near(few[at], few[at + lag], threshold)]
        left.append(few[at])
        right.append(few[at + lag])
    for k in np.flatnonzero(sizes > _SMALL_CELL):
        for root, found in _reach(prints[first[k] : first[k] + sizes[k]], threshold):
            left.append(np.full(len(found), root, np.uint64))
            right.append(found)
    ends = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (left, right)]
    return pa.record_batch([pa.array(x) for x in ends], names=["a", "b"])


def links(prints: DataFrame, threshold: int = THRESHOLD, groups: int = GROUPS) -> DataFrame:
    """(a, b) links of distinct fingerprints (column fp) that connect all pairs within `threshold`.

    Small cells give all their pairs within reach. In a large cell (near copies of one text) the
    search goes on from what it has reached and compares only with what is left, so its links are
    fewer than its members; every pair within reach still ends in one component. A task holds the
    distinct fingerprints of one cell at a time.
    """
    order = sorted(range(32), key=lambda k: k % groups)
    masks = [sum(3 << (2 * k) for k in order if k % groups in chosen) for chosen in combinations(range(groups), groups - threshold)]
    fp = F.col("fp")
    half = F.shiftrightunsigned(fp, 1)
    code = fp.bitwiseOR(half).bitwiseAND(F.lit(_LOW_BITS)).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(_LOW_BITS)), 1))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = prints.select("fp", code.alias("code")).select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("grid"), F.col("code").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(signed)])).alias("c")
    )
    cells = cells.select("c.grid", "c.cell", "fp").repartition("grid", "cell").sortWithinPartitions("grid", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            grid, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            whole = np.flatnonzero((grid != grid[-1]) | (cell != cell[-1]))
            if len(whole):
                end = int(whole[-1]) + 1
                yield _cell_links(pa.Table.from_batches([*kept[:-1], batch.slice(0, end)]), threshold)
                kept = [batch.slice(end)]
            elif len(kept) > 1:
                head = kept[0]
                if head.column(0)[-1] != batch.column(0)[0] or head.column(1)[-1] != batch.column(1)[0]:
                    yield _cell_links(pa.Table.from_batches(kept[:-1]), threshold)
                    kept = [batch]
        if kept:
            yield _cell_links(pa.Table.from_batches(kept), threshold)

    return cells.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(id, fp, component_id) for every row of `docs`.

    Rows: null and empty texts have fingerprint zero and link to each other. Repeated rows come
    back as often as they are given. A component's id is its smallest id; null ids never are,
    unless a component has no other. Other columns of `docs` are ignored. An empty table gives
    an empty result. Exact copies and equal fingerprints meet as one node before any pairing.
    """
    rows = written(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), threshold), "simhash-links")
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(id_col, "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
