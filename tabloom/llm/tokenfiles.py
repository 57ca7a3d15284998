"""Token ids on disk: each document compressed by itself with one shared zstandard dictionary.

A dataset is two Parquet tables. `dictionary` holds the dictionary and its SHA-256. `blocks` holds
runs of documents in ascending id order: their ids, an offset index, and one zstandard frame per
document, so that a short document is read without its neighbours. Spark writes both, so any
store that Spark reaches will do. A block carries the hash of the dictionary that it needs.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.bpe import Layout, pretokens
from tabloom.llm.common import shared_folder, text_or_empty

#: The dictionary is trained on this many documents at most (smallest hash of the id first) ...
SAMPLE_DOCS = 1000
#: ... and on this many bytes at most of each one's serialized ids, from its middle.
SAMPLE_BYTES = 4096
DICTIONARY_BYTES = 32768
BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096
#: Pre-tokens that are laid out at once: more of them at a time repeat fewer look-ups.
RUN = 2_000_000
#: Bytes of pre-tokens that a task remembers.
REMEMBERED = 64 << 20
BLOCKS = "part int, block int, dict_sha256 string, n_docs int, first_id long, last_id long, doc_ids binary, counts binary, offsets binary, frames binary"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer and how many bytes each id stands for: byte-level tokens have a character per byte."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    widths[list(vocabulary.values())] = list(map(len, vocabulary))
    return tokenizer, widths


def _layout(path: str) -> Layout:
    """Pre-tokens encoded by the library as one pre-split sequence; each one's ids end where its bytes do."""
    tokenizer, widths = _tokenizer(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [tokenizer.encode_batch_fast([words[at : at + 2048]], is_pretokenized=True, add_special_tokens=False)[0].ids for at in range(0, len(words), 2048)]
        ids = np.concatenate([np.array(x, "<u4") for x in runs])
        ends = np.cumsum(widths[ids])
        wanted = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        last = np.searchsorted(ends, wanted)
        if len(ends) != last[-1] + 1 or not np.array_equal(ends[last], wanted):
            raise ValueError(f"{path} is not a byte-level vocabulary")
        return ids, np.diff(last + 1, prepend=0)

    return Layout(encode, RUN, REMEMBERED)


def _prepared(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """Pre-tokens of each text; a text that holds a special token's string stays whole instead."""
    special = [t.content for t in _tokenizer(path)[0].get_added_tokens_decoder().values()]
    text = text_or_empty(text_col)
    held = F.lit(False)
    for content in special:
        held = held | text.contains(content)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.when(held, F.array().cast("array<string>")).otherwise(pretokens(text, pattern)).alias("words"), F.when(held, text).alias("whole"))


def _ids(batch: pa.RecordBatch, path: str, layout: Layout, end: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """Ids of each row of a batch, in order, each closed by `end`."""
    whole = batch.column(2)
    for first, ids, rows in layout(batch.column(1)):
        for one in end:
            ids, rows = np.insert(ids, rows[1:], one), rows + np.arange(len(rows))
        bounds = rows.tolist()
        texts = whole.slice(first, len(rows) - 1)
        special = {k: texts[k].as_py() for k in np.flatnonzero(texts.is_valid()).tolist()}
        for k in range(len(rows) - 1):
            if k in special:
                yield np.array([*_tokenizer(path)[0].encode(special[k], add_special_tokens=False).ids, *end], "<u4")
            else:
                yield ids[bounds[k] : bounds[k + 1]]


def train_dictionary(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str) -> bytes:
    """A dictionary from a bounded sample of serialized id arrays; empty if there is nothing to learn from."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).distinct()
    chosen = docs.join(F.broadcast(ids), F.col(id_col).eqNullSafe(F.col("id"))).select(id_col, text_col)
    sample = _prepared(chosen, path, pattern, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = _layout(path)
        for batch in batches:
            parts = []
            for ids in _ids(batch, path, layout):
                at = max(0, len(ids) - SAMPLE_BYTES // 4) // 2
                parts.append(ids[at : at + SAMPLE_BYTES // 4].tobytes())
            yield pa.record_batch([batch.column(0), pa.array(parts, pa.binary())], names=["id", "ids"])

    samples = [bytes(r[1]) for r in sorted(sample.mapInArrow(run, "id long, ids binary").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) if r[1]][:SAMPLE_DOCS]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None


def write(docs: DataFrame, folder: str, tokenizer_path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode, close every document with `end_id` and write the two tables under `folder`.

    Null texts count as empty (the end id alone). Repeated ids stay, side by side; null ids come
    first. Other columns are ignored. An empty table gives a dataset without blocks.
    """
    spark = docs.sparkSession
    source = docs.select(id_col, text_col)
    dictionary = train_dictionary(source, tokenizer_path, pattern, id_col, text_col)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    ordered = _prepared(source.repartitionByRange(id_col).sortWithinPartitions(id_col), tokenizer_path, pattern, id_col, text_col).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, layout = _codec(dictionary), _layout(tokenizer_path)
        compress = zstandard.ZstdCompressor(level=3, dict_data=codec, write_content_size=True, write_checksum=True).compress
        names, kinds = zip(*(x.split() for x in BLOCKS.split(", ")), strict=True)
        made, size, frames, counts, doc_ids, part = 0, 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<i8")
            known = [x for x in doc_ids if x is not None]
            present = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
            row = [part, made, digest, len(frames), known[0] if known else None, known[-1] if known else None, present + np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(counts, "<i8").tobytes(), offsets.tobytes(), b"".join(frames)]
            types = {"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
            return pa.record_batch([pa.array([x], types[k]) for x, k in zip(row, kinds, strict=True)], names=list(names))

        for batch in batches:
            ids_col = batch.column(0).to_pylist()
            if batch.num_rows:
                part = batch.column(3)[0].as_py()
            for k, ids in enumerate(_ids(batch, tokenizer_path, layout, (end_id,))):
                frames.append(compress(ids))
                counts.append(len(ids))
                doc_ids.append(ids_col[k])
                size += len(frames[-1])
                if size >= BLOCK_BYTES or len(frames) >= BLOCK_DOCS:
                    yield block()
                    made, size, frames, counts, doc_ids = made + 1, 0, [], [], []
        if frames:
            yield block()

    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, ids: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(part, block, place, id, n_tokens, ids) of all documents, or of those with the given ids.

    For given ids only the blocks that can hold them are read and only their frames decompressed.
    """
    digest, dictionary = (bytes(x) if isinstance(x, bytearray) else x for x in spark.read.parquet(f"{folder}/dictionary").first())
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"{folder}: the dictionary does not have its hash")
    blocks = spark.read.parquet(f"{folder}/blocks")
    if ids is not None:
        wanted = F.lit(False)
        for x in ids:
            wanted = wanted | F.lit(x).between(F.col("first_id"), F.col("last_id"))
        blocks = blocks.where(wanted)
    chosen = None if ids is None else frozenset(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(dictionary)
        expand = zstandard.ZstdDecompressor(dict_data=codec).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError(f"block {row['part']}/{row['block']} needs dictionary {row['dict_sha256']}")
                n = row["n_docs"]
                present = np.frombuffer(row["doc_ids"], np.uint8, n).astype(bool)
                keys = np.frombuffer(row["doc_ids"], "<i8", n, offset=n)
                counts, offsets = np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["offsets"], "<i8").tolist()
                at = [k for k in range(n) if chosen is None or present[k] and int(keys[k]) in chosen]
                frames = [expand(row["frames"][offsets[k] : offsets[k + 1]]) for k in at]
                yield pa.record_batch(
                    [pa.array([row["part"]] * len(at), pa.int32()), pa.array([row["block"]] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(keys[at], pa.int64(), mask=~present[at]), pa.array(counts[at], pa.int64()), pa.array(frames, pa.binary())],
                    names=["part", "block", "place", id_col, "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, f"part int, block int, place int, {id_col} long, n_tokens long, ids binary")


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, start): ids before each block, from the index alone. One window holds a row per part."""
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(x.as_py(), "<i8").sum()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["part", "block", "held"])

    held = blocks.mapInArrow(run, "part int, block int, held long")
    parts = held.groupBy("part").agg(F.sum("held").alias("held"))
    before = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    inside = held.select("part", "block", (F.sum("held").over(Window.partitionBy("part").orderBy("block")) - F.col("held")).alias("inside"))
    return inside.join(before, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start"))


def read_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with `start`, the number of ids before them in the whole dataset."""
    docs = read(spark, folder)
    within = Window.partitionBy("part", "block").orderBy("place")
    found = docs.select("part", "block", "place", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    found = found.withColumn("within", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    return found.join(starts(spark, folder), ["part", "block"]).select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document through the files: written in id order, read back with positions."""
    import public_tokenizers

    folder = f"{shared_folder(spark)}/llm/tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return read_positions(spark, folder)


def checksum(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
