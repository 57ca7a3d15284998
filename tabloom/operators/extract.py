"""Tables out of pages, and the cleaning of table collections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import hashing, text
from tabloom.model import HEADER_ROW, body
from tabloom.operators.layout import materialize
from tabloom.operators.ranking import group_rank

_TABLE_TAG = re.compile(rb"(?P<open><table)|</table>", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A tag in its plain form; markup made of such tags and text needs no tolerant parser.
_PLAIN_TAG = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9-]*="[^"<>&]*")*)[ \t\n\r\f]*(/?)>')
_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
_RAW_TEXT = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())
_BLANKS = re.compile(r"[\r\n]+|\s{2,}")


def table_spans_of(html: bytes) -> list[tuple[int, int]]:
    """Byte spans of all tables of a page, nested ones too; unbalanced tags are skipped."""
    begins, spans = [], []
    for tag in _TABLE_TAG.finditer(html):
        if tag["open"]:
            begins.append(tag.start())
        elif begins:
            spans.append((begins.pop(), tag.end()))
    return sorted(spans)


def element_spans(pages: DataFrame, tag: str = "table") -> DataFrame:
    """(page_id, ix, begin, end): bytes of every element of a tag, nested and empty ones too, by place.

    pages (page_id, html), page_id being a key; a null page has none. Tags in either case are
    events whose running sum is the depth: a close at the least sum so far has nothing to close
    and is skipped. Of the others, opens and closes of one level alternate, so an element ends
    at the next event of its level; an element without one is skipped.
    """
    bytes_as_chars = F.decode(F.col("html").cast("binary"), "ISO-8859-1")
    pattern = rf"(?i)<{tag}|</{tag}>"
    tags = F.regexp_extract_all("_raw", F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split("_raw", pattern, -1), lambda g: F.length(g))
    pairs = F.slice(F.arrays_zip(gaps.alias("gap"), tags.alias("tag")), F.lit(1), F.size(tags))
    events = pages.where(bytes_as_chars.rlike(pattern)).select("page_id", bytes_as_chars.alias("_raw")).select("page_id", F.posexplode(pairs).alias("n", "e"))
    opens = ~F.startswith("e.tag", F.lit("</"))
    so_far = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = events.select("page_id", "n", opens.alias("opens"), F.length("e.tag").alias("size"), F.sum(F.col("e.gap") + F.length("e.tag")).over(so_far).alias("end"), F.sum(F.when(opens, 1).otherwise(-1)).over(so_far).alias("total"))
    floored = placed.withColumn("floor", F.least(F.lit(0), F.min("total").over(so_far)))
    before = F.lag("floor", 1, 0).over(Window.partitionBy("page_id").orderBy("n"))
    level = F.col("total") - F.col("floor") + F.when(F.col("opens"), 0).otherwise(1)
    kept = floored.withColumn("skipped", F.col("floor") < before).where("NOT skipped").withColumn("level", level)
    close = F.lead("end").over(Window.partitionBy("page_id", "level").orderBy("n"))
    found = kept.withColumn("close", close).where("opens AND close IS NOT NULL").select("page_id", (F.col("end") - F.col("size")).cast("int").alias("begin"), F.col("close").cast("int").alias("end"))
    ix = F.row_number().over(Window.partitionBy("page_id").orderBy("begin")) - 1
    return found.select("page_id", ix.alias("ix"), "begin", "end")


class _FirstTable(HTMLParser):
    """Grid of the first table: rows of (is_header_cell, text, columns, rows spanned)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.hidden, self.done = 0, [], False
        self.rows, self.cell, self.in_head, self.infobox = [], None, False, False

    def read(self, markup: str) -> None:
        """Feed all of the markup; when it consists of plain tags, by one split instead of the tolerant scan."""
        parts = _PLAIN_TAG.split(markup)
        tags = [tag.lower() for tag in parts[2::5]]
        ends, attributes, voids = parts[1::5], parts[3::5], parts[4::5]
        odd = any(end and (more or void) for end, more, void in zip(ends, attributes, voids))
        if markup.count("<") != len(tags) or odd or not tags or parts[-1] or not _RAW_TEXT.isdisjoint(tags):
            self.feed(markup)
            self.close()
            return
        for data, end, tag, more, void in zip(parts[0::5], ends, tags, attributes, voids):
            if data and self.cell:
                self.handle_data(unescape(data) if "&" in data else data)
            if end:
                self.handle_endtag(tag)
            else:
                given = [(name.lower(), value) for name, value in _ATTRIBUTE.findall(more)] if more else ()
                (self.handle_startendtag if void else self.handle_starttag)(tag, given)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.done:
            return
        if self.hidden or attrs.get("style") == "display:none":
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.infobox = "infobox" in (attrs.get("class") or "").split()
        elif self.depth == 1:
            if tag == "thead":
                self.in_head = True
            elif tag == "tr":
                self.close_cell()
                self.rows.append((self.in_head, []))
            elif tag in ("td", "th"):
                self.close_cell()
                if not self.rows:
                    self.rows.append((self.in_head, []))
                wide = attrs.get("colspan") or "1"
                tall = attrs.get("rowspan") or "1" if tag == "th" else "1"
                self.cell = [tag == "th", [], int(wide) if wide.isdigit() else 1, int(tall) if tall.isdigit() else 1]

    def handle_startendtag(self, tag, attrs):
        if tag == "br" and self.cell and not self.hidden:
            self.cell[1].append(" ")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.close_cell()
                self.done = True
        elif self.depth == 1:
            if tag == "thead":
                self.in_head = False
            if tag in ("td", "th", "tr", "thead", "tbody"):
                self.close_cell()

    def handle_data(self, data):
        if self.cell and not self.hidden and not self.done:
            self.cell[1].append(data)

    def close_cell(self):
        if self.cell:
            is_header, parts, wide, tall = self.cell
            clean = _BLANKS.sub(" ", "".join(parts)).strip()
            self.rows[-1][1].append((is_header, clean, wide, tall))
            self.cell = None


def _grid(table: _FirstTable) -> tuple[list[list[str]], int]:
    """Rectangular texts and the number of leading header rows."""
    head = [cells for in_head, cells in table.rows if in_head and cells]
    rest = [cells for in_head, cells in table.rows if not in_head and cells]
    if not head:
        while rest and all(c[0] for c in rest[0]):
            head.append(rest.pop(0))

    def expand(rows):
        if all(wide <= 1 and tall <= 1 for cells in rows for _, _, wide, tall in cells):
            return [[c[1] for c in cells] for cells in rows]
        out, pending = [], {}
        for cells in rows:
            line, queue = [], list(cells)
            while queue or len(line) in pending:
                at = len(line)
                if at in pending:
                    value, left = pending.pop(at)
                    line.append(value)
                    if left > 1:
                        pending[at] = (value, left - 1)
                    continue
                _, value, wide, tall = queue.pop(0)
                for _ in range(max(wide, 1)):
                    if tall > 1:
                        pending[len(line)] = (value, tall - 1)
                    line.append(value)
            out.append(line)
        return out

    head, rest = expand(head), expand(rest)
    width = max((len(r) for r in head + rest), default=0)
    lines = [r + [""] * (width - len(r)) for r in head + rest]
    if width == 1:
        lines = lines[: len(head)] + [r for r in lines[len(head) :] if r[0]]
    return lines, len(head)


def _header_names(row: list[str]) -> list[str]:
    """Blank names get their position, repeated names a running suffix."""
    seen, names = {}, []
    for i, name in enumerate(row):
        name = name or f"Unnamed: {i}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(f"{name}.{count}" if count else name)
    return names


OUT_ROWS = 20_000
_PAGE_CELLS = (
    "page_id {id}, table_ix int, begin int, end int, infobox boolean, n_header_rows int, row int, col int, text string"
)


_PAGE_COLUMNS = ["page_id", "table_ix", "begin", "end", "infobox", "n_header_rows", "row", "col", "text"]


def page_cells(pages: DataFrame) -> DataFrame:
    """Cells of every table of every page: (page_id, html) in, long cells out.

    Rows spanned by body cells are not repeated, hidden elements are dropped, and a
    line break inside a cell is a space. Python, one Arrow batch at a time, because
    nested markup has no SQL form; pages are independent of each other.
    """

    kind = pages.schema["page_id"].dataType.simpleString()

    def made(page_ids: pa.Array, tables: list[tuple], sizes: list[int], rows: list[int], widths: list[int], texts: list[str]) -> pa.RecordBatch:
        """Tables (place of the page, facts), cells of each; lines (row, width); texts of all cells in order."""
        place, *facts = (np.repeat(np.array(column), sizes) for column in zip(*tables))
        ends = np.cumsum(widths)
        cols = np.arange(len(texts)) - np.repeat(ends - widths, widths)
        numbers = [pa.array(column, pa.bool_() if column.dtype == bool else pa.int32()) for column in (*facts, np.repeat(rows, widths), cols)]
        return pa.RecordBatch.from_arrays([page_ids.take(pa.array(place)), *numbers, pa.array(texts, pa.string())], _PAGE_COLUMNS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, sizes, rows, widths, texts = [], [], [], [], []
            page_ids, pages_html = batch.column("page_id"), batch.column("html")
            for place in range(batch.num_rows):
                raw = (pages_html[place].as_py() or "").encode()
                for table_ix, (begin, end) in enumerate(table_spans_of(raw)):
                    parser = _FirstTable()
                    parser.read(raw[begin:end].decode("utf-8", "replace"))
                    lines, n_head = _grid(parser)
                    if n_head == 1:
                        lines[0] = _header_names(lines[0])
                    before = len(texts)
                    for r, line in enumerate(lines):
                        rows.append(r - n_head)
                        widths.append(len(line))
                        texts.extend(line)
                    tables.append((place, table_ix, begin, end, parser.infobox, n_head))
                    sizes.append(len(texts) - before)
                if len(texts) >= OUT_ROWS:
                    yield made(page_ids, tables, sizes, rows, widths, texts)
                    tables, sizes, rows, widths, texts = [], [], [], [], []
            if texts:
                yield made(page_ids, tables, sizes, rows, widths, texts)

    return pages.select("page_id", "html").mapInArrow(scan, _PAGE_CELLS.format(id=kind))


def standard_tables(cells: DataFrame, keys: list[str] = ["table_id"]) -> DataFrame:
    """Keys of ordinary tables: one header row, and not mostly rows that repeat one text.

    Fails when the rows with a single distinct text exceed half of the rows less one.
    """
    rows = cells.groupBy(*keys, "row").agg((F.min("text") == F.max("text")).alias("flat"))
    n_rows = F.count_if(F.col("row") >= 0)
    flat = F.count_if((F.col("row") >= 0) & F.col("flat"))
    return (
        rows.groupBy(*keys)
        .agg(n_rows.alias("n"), flat.alias("flat"), F.count_if(F.col("row") == HEADER_ROW).alias("heads"))
        .where((F.col("heads") == 1) & ~(F.col("flat") > F.col("n") / 2 - 1))
        .select(*keys)
    )


def transpose_infoboxes(cells: DataFrame, keys: list[str] = ["table_id"]) -> DataFrame:
    """Key/value tables as one wide row: every row becomes a column.

    The first header cell (or its position) comes first, under a blank header. A row
    of one cell, or of two equal cells, is a value without a header; otherwise the
    first cell is the header and the rest, joined, the value.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"])
    rows = cells.groupBy(*keys, "row").agg(ordered.alias("v"))
    v = F.col("v")
    first, rest = F.element_at(v, 1), F.array_join(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), " ")
    bare = (F.size(v) < 2) | ((F.size(v) == 2) & (first == F.element_at(v, -1)))
    pair = F.struct(F.when(bare, "").otherwise(first).alias("header"), F.when(bare, first).otherwise(rest).alias("value"))
    columns = rows.where("row >= 0").select(*keys, (F.col("row") + 1).alias("col"), pair.alias("p"))
    title = F.coalesce(F.max(F.when(F.col("row") == HEADER_ROW, first)), F.lit("0"))
    titles = rows.groupBy(*keys).agg(title.alias("value")).select(
        *keys, F.lit(0).alias("col"), F.struct(F.lit("").alias("header"), F.col("value")).alias("p")
    )
    both = F.array(F.struct(F.lit(HEADER_ROW).alias("row"), F.col("p.header").alias("text")), F.struct(F.lit(0).alias("row"), F.col("p.value").alias("text")))
    return titles.unionByName(columns).select(*keys, "col", F.explode(both).alias("e")).select(*keys, "e.row", "col", "e.text")


def rectangular(cells: DataFrame) -> DataFrame:
    """table_ids with a header and rows, every row as wide as the header."""
    rows = cells.groupBy("table_id", "row").agg(F.count("*").alias("n"))
    return (
        rows.groupBy("table_id")
        .agg(
            F.max(F.when(F.col("row") == HEADER_ROW, F.col("n"))).alias("wide"),
            F.min(F.when(F.col("row") >= 0, F.col("n"))).alias("low"),
            F.max(F.when(F.col("row") >= 0, F.col("n"))).alias("high"),
        )
        .where("wide = low AND wide = high")
        .select("table_id")
    )


def fill_ids(records: DataFrame, key: str, *columns: str) -> DataFrame:
    """Missing or blank ids take the record key."""
    return records.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(key)) for c in columns})


def at_least(tables: DataFrame, rows: int, cols: int) -> DataFrame:
    return tables.where((F.col("n_rows") >= rows) & (F.col("n_cols") >= cols))


def duplicate(records: DataFrame, key: str, times: int) -> DataFrame:
    """Each record `times` times, with the copy number appended to its key."""
    copies = records.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn(key, F.concat_ws("_", F.col(key).cast("string"), F.col("_copy").cast("string"))).drop("_copy")


def blank_tables(tables: DataFrame) -> DataFrame:
    """Replace the content of every table by one blank header over one blank cell."""
    return tables.withColumns(
        {"columns": F.array(F.lit("")), "cells": F.array(F.array(F.lit(""))), "n_rows": F.lit(1), "n_cols": F.lit(1)}
    )


def shard_of_row(row: Column, n_rows: Column, max_rows: Column) -> Column:
    """struct<begin,end> of the shard of a row: halve the range until it fits.

    The halving depends on the row and the table's size only, so no rows have to meet.
    """
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(n_rows, F.lit(2)).cast("double"))).cast("int") + 1)
    whole = F.struct(F.lit(0).alias("begin"), n_rows.cast("int").alias("end"))

    def halve(at: Column, _: Column) -> Column:
        pivot = at["begin"] + F.floor((at["end"] - at["begin"]) / 2).cast("int")
        left = F.struct(at["begin"].alias("begin"), pivot.alias("end"))
        right = F.struct(pivot.alias("begin"), at["end"].alias("end"))
        return F.when(at["end"] - at["begin"] <= max_rows, at).when(row < pivot, left).otherwise(right)

    return F.aggregate(steps, whole, halve)


def shard_rows(tables: DataFrame, cells: DataFrame, max_cells: int = 50) -> DataFrame:
    """Body cells cut into shards of at most max_cells cells; shards of one row are dropped.

    (table_id, shard_begin, shard_end, row, col, text), rows counted from 0 in each shard.
    Tables with fewer than two rows or columns, or wider than max_cells, give nothing.
    """
    fitting = at_least(tables, 2, 2).where(F.col("n_cols") <= max_cells).select("table_id", "n_rows", "n_cols")
    budget = F.floor(F.lit(max_cells) / F.col("n_cols")).cast("int")
    placed = body(cells).join(fitting, "table_id").withColumn("s", shard_of_row(F.col("row"), F.col("n_rows"), budget))
    return placed.where("s.end - s.begin >= 2").select(
        "table_id",
        F.col("s.begin").alias("shard_begin"),
        F.col("s.end").alias("shard_end"),
        (F.col("row") - F.col("s.begin")).alias("row"),
        "col",
        "text",
    )


def seed_of(c: Column) -> Column:
    """Seed of a text id: sha-256 of the quoted text modulo 2^32 - 1."""
    return hashing.fingerprint32(F.concat(F.lit("'"), c, F.lit("'")))


def rekey(c: Column) -> Column:
    """Hashed id as hexadecimal text."""
    return F.concat(F.lit("0x"), F.lower(F.hex(seed_of(c))))


def split_of(table_id: Column, n_shards: int) -> Column:
    """'test' for one shard out of n by hash of the table id, else 'train'."""
    return F.when(seed_of(table_id) % n_shards == 0, "test").otherwise("train")


def split_by_title(original: Column, title: Column, train_share: float = 0.9) -> Column:
    """Original dev becomes test; train is divided by hash of the document title."""
    return F.when(original == "dev", "test").when(hashing.hash_uniform(title) < train_share, "train").otherwise("dev")


def sample_count(key: Column, rate: Column) -> Column:
    """Copies for a fractional sampling rate: its integer part, plus one by a draw from the key."""
    whole = F.floor(rate)
    return (whole + (hashing.hash_uniform(key) < rate - whole).cast("int")).cast("int")


def resample(records: DataFrame, key: str, rates: DataFrame, on: list[str]) -> DataFrame:
    """Copies of records by their sampling rate; records without a rate are kept once.

    rates (…on, rate) has one row per file and class, so it is small by construction.
    """
    rated = records.join(rates, on, "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))
    n = sample_count(F.col(key).cast("string"), F.col("rate"))
    return rated.withColumn("copies", n).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))


def retrieval_sentences(records: DataFrame, low: int = 4, high: int = 32) -> DataFrame:
    """Titled records to one example per sentence with low to high tokens.

    records (record_id, title, text). Paragraphs are split first, then sentences.
    """
    titled = records.where(F.coalesce(F.length("title"), F.lit(0)) > 0).withColumn("record_id", rekey(F.col("record_id")))
    parts = titled.select("record_id", "title", F.explode(F.split("text", "\n")).alias("paragraph")).select(
        "record_id", "title", F.explode(text.sentences(F.col("paragraph"))).alias("sentence")
    )
    sized = parts.where(F.size(text.tokenize(F.col("sentence"))).between(low, high))
    pair = F.concat(F.lit("('"), "record_id", F.lit("', '"), "sentence", F.lit("')"))
    new_id = F.concat(F.lit("0x"), F.lower(F.hex(hashing.fingerprint32(pair))))
    return sized.select(new_id.alias("question_id"), "record_id", "title", "sentence").distinct()


def scrub(raw: Column) -> Column:
    """Binary text as string; anything that is not valid UTF-8 becomes blank."""
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.lit(""))


def with_blank_questions(tables: DataFrame, questions: DataFrame) -> DataFrame:
    """Tables with their questions; tables without one get a blank question with id FAKE."""
    return tables.join(questions, "table_id", "left").withColumns(
        {"question_id": F.coalesce("question_id", F.lit("FAKE")), "text": F.coalesce("text", F.lit(""))}
    )


def table_fingerprints(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Content id of each table: title, '_' and the hash of its normalised texts in order."""
    ordered = F.sort_array(F.collect_list(F.struct("row", "col", text.normalize_for_match(F.col("text")).alias("text"))))
    texts = F.array_join(F.transform(ordered, lambda c: c["text"]), "###")
    prints = cells.groupBy("table_id").agg(hashing.fingerprint_hex(texts).alias("fingerprint"))
    return tables.join(prints, "table_id").withColumn("content_id", F.concat_ws("_", "document_title", "fingerprint"))


def random_pairs(records: DataFrame, n_bins: int | None = None, n_shards: int = 20, seed: int = 0) -> DataFrame:
    """Pair every record with the table of another one of its split and, if bins are wanted, its hash bin.

    records (key, table_id). Records are paired in a ring by seeded SHA-256 of their key, so train
    and test never mix; a neighbour with the same table gives no pair (null). Places in a ring
    come from range partitions, so it may be of any size.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col("key").cast("string")), 256)
    bin_of = F.lit(0) if n_bins is None else F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_bins
    placed = records.select("key", "table_id", split_of(F.col("table_id"), n_shards).alias("split"), bin_of.alias("_bin"), digest.alias("_order"))
    ring = ["split", "_bin"]
    ranked = materialize(group_rank(placed, ring, [F.col("_order"), F.col("key")], "_place"))
    sizes = ranked.groupBy(*ring).agg((F.max("_place") + 1).alias("_size"))
    following = ranked.select(*ring, F.col("_place").alias("_next"), F.col("table_id").alias("_other"))
    asked = ranked.join(sizes, ring).withColumn("_next", (F.col("_place") + 1) % F.col("_size"))
    paired = asked.join(following, [*ring, "_next"])
    return paired.select("key", "table_id", "split", F.when(F.col("_other") != F.col("table_id"), F.col("_other")).alias("random_table_id"))
