"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers bit-parallel verification.

An item of m characters may differ by `rate * m` edits and is split into one piece more than
that, so that one piece at least survives unedited wherever the item occurs. All pieces are
looked up in a text in one Aho-Corasick pass. A hit climbs a binary tree over the pieces: a node
of c pieces must match around the hit with at most c - 1 edits (if both halves had as many edits
as pieces, so had the whole), so chance hits end after a few characters. The root's distance is
the result. Texts and items are compared in lower case with single spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed per character of an item.
RATE = 0.08
#: Characters of items that one pass over the texts looks for; more items take more passes.
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(positions: dict[str, int], m: int, text: str) -> int:
    """Smallest edit distance of a pattern to any substring of `text`; `positions` holds a bit per place of a character."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, here, best = full, 0, m, m
    get = positions.get
    for ch in text:
        eq = get(ch, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        down = eq | minus
        up = minus | (full & ~(across | plus))
        fall = plus & across
        if up & high:
            here += 1
        elif fall & high:
            here -= 1
            if here < best:
                best = here
        up <<= 1
        plus = full & ((fall << 1) | ~(down | up))
        minus = up & down & full
    return best


class Items:
    """The pieces of a block of items, ready to be looked for."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], rate: float) -> None:
        self.items, self.cuts, self.nodes = items, [], {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            count = min(int(rate * len(text)) + 1, len(text))
            cuts = [len(text) * j // count for j in range(count + 1)]
            self.cuts.append(cuts)
            for j in range(count):
                pieces.setdefault(text[cuts[j] : cuts[j + 1]], []).append((k, j))
        self.finder = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.finder.add_word(piece, (len(piece), owners))
        if pieces:
            self.finder.make_automaton()
        self.empty = not pieces

    def node(self, k: int, low: int, high: int) -> tuple[dict[str, int], int]:
        found = self.nodes.get((k, low, high))
        if found is None:
            cuts = self.cuts[k]
            text = self.items[k][1][cuts[low] : cuts[high]]
            bits: dict[str, int] = {}
            for at, ch in enumerate(text):
                bits[ch] = bits.get(ch, 0) | 1 << at
            found = self.nodes[k, low, high] = (bits, len(text))
        return found

    def distance(self, k: int, j: int, start: int, text: str) -> int | None:
        """Edits of item k around its piece j at `start`, or None if it is not there."""
        cuts = self.cuts[k]
        count, span = len(cuts) - 1, 1
        while span < count:
            span *= 2
            low = j // span * span
            high = min(count, low + span)
            if span < count:
                slack = allowed = high - low - 1
            else:
                allowed = count - 1
                slack = 2 * allowed
            if high - low > 1:
                bits, m = self.node(k, low, high)
                begin = start - (cuts[j] - cuts[low]) - slack
                best = myers(bits, m, text[max(0, begin) : begin + m + 2 * slack])
                if best > allowed:
                    return None
        return 0 if count == 1 else best

    def search(self, text: str) -> list[tuple[int, int]]:
        """(place of the item, smallest distance) of every item that occurs in a normalised text."""
        best: dict[int, int] = {}
        checked: dict[int, list[tuple[int, int]]] = {}
        if self.empty or not text:
            return []
        for end, (length, owners) in self.finder.iter(text):
            start = end - length + 1
            for k, j in owners:
                if best.get(k) == 0:
                    continue
                diagonal, reach = start - self.cuts[k][j], len(self.cuts[k]) - 2
                seen = checked.get(k)
                if seen and any(abs(diagonal - d) <= reach for d in seen[-4:]):
                    continue  # the window already compared covers every place this hit can stand for
                found = self.distance(k, j, start, text)
                if found is not None:
                    checked.setdefault(k, []).append(diagonal)
                    best[k] = min(found, best.get(k, found))
        return sorted(best.items())


@lru_cache(maxsize=2)
def _prepared(items: tuple[tuple[int | None, str], ...], rate: float) -> Items:
    return Items(items, rate)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[tuple[int | None, str], ...]]:
    """Distinct non-empty items in blocks of about BLOCK_CHARS characters."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // BLOCK_CHARS)
    for k in range(count):
        block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).collect()
        items = sorted({(r[0], normal(r[1])) for r in block if normal(r[1])}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        if items:
            yield tuple(items)


def mark(docs: DataFrame, benchmark: DataFrame, into: str = "hits", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """`docs` with array<struct<item_id, distance>> `into`: the items that each whole text holds.

    Null and empty texts hold nothing; null and empty items are held by nothing. Items repeated
    with the same id and text count once. Other columns, repeated rows and null ids pass
    unchanged; a column already named `into` is replaced. An empty table on either side gives no
    hits. Items are sent to the tasks block by block, so their number is not limited.
    """
    kind = "array<struct<item_id:bigint,distance:int>>"
    arrow_kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    hits = F.array().cast(kind)
    for items in item_blocks(benchmark, item_id_col, item_text_col):

        def run(batches: Iterator[pa.Array], items=items) -> Iterator[pa.Array]:
            finder = _prepared(items, rate)
            for texts in batches:
                found = [[{"item_id": items[k][0], "distance": d} for k, d in finder.search(normal(text.as_py()))] for text in texts]
                yield pa.array(found, arrow_kind)

        hits = F.concat(hits, F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER)(F.col(text_col).cast("string")))
    return docs.withColumn(into, hits)


def op10_pigeonhole_edits(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair where the text holds the item within its edit budget."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.distance")
