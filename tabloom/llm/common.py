"""Shared steps: tables in the shared folder, row keys, regex spans, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Temporary folders of local sessions, by application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new temporary one in local mode when it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="tabloom-llm-")
    return _local_folders[application]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by `written`; nothing may read it afterwards."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of `links` (a, b), root being the smallest node reachable.

    Alternating large-star and small-star steps: each is one map-combined minimum per node and
    one join, so a hub costs a counter, not a neighbour list; its join side is split by AQE.
    Every round is a table in the shared folder. Self links and nulls are ignored.
    """

    def mark(edges: DataFrame) -> tuple:
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        signature = mark(after)
        drop_written(edges)
        edges = after
        if signature == before:
            break
        before = signature
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


class Kind:
    """A kind of span: its pattern, the group that is its value, and the SQL test that a match must pass."""

    def __init__(self, name: str, pattern: str, group: int = 0, test: str = "true") -> None:
        self.name, self.pattern, self.group, self.test = name, pattern, group, test


def row_keys(id_col: str, text: Column) -> list[Column]:
    """Two hashes of a row's id and text: 128 bits that stand for the row in joins."""
    number = F.col(id_col).cast("long")
    return [F.xxhash64(number, text).alias("k1"), F.xxhash64(text, F.lit("row"), number).alias("k2")]


def scan(docs: DataFrame, kinds: list[Kind], id_col: str, text_col: str, name: str) -> DataFrame:
    """One pass over whole texts, written: (id, k1, k2, t, found) for every row.

    `found` has a struct per match of any kind: the kind, its number among them, the lengths of
    the gap before it and of itself, and its value. `t` is a hash of the text alone.
    """
    text = F.col("_text")
    arrays = []
    for kind in kinds:
        matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        gaps = F.split(text, kind.pattern, -1)
        fields = [
            F.transform(gaps, lambda g: F.length(g)).alias("gap"),
            F.transform(matches, lambda m: F.length(m)).alias("size"),
            (matches if kind.group == 0 else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))).alias("value"),
        ]
        zipped = F.slice(F.arrays_zip(*fields), 1, F.size(matches))
        rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind.name).alias("kind"), i.alias("number"), *[x[f].alias(f) for f in ("gap", "size", "value")]))
        kept = F.when(text.rlike(kind.pattern), rows)
        arrays.append(kept)
    source = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("_text"))
    scanned = source.select(id_col, *row_keys(id_col, text), F.xxhash64(text).alias("t"), F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull())).alias("found"))
    return written(scanned, name)


def spans(scanned: DataFrame, kinds: list[Kind]) -> DataFrame:
    """(k1, k2, t, kind, start, end, value, ...) of the matches that pass, once per distinct row.

    Offsets add up over the matches of one kind in one row, dropped ones included.
    """
    rows = scanned.where(F.size("found") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", "t", F.explode("found").alias("m")).select("k1", "k2", "t", "m.*")
    ends = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("k1", "k2", "kind").orderBy("number"))
    placed = rows.withColumn("end", ends.cast("long")).withColumn("start", F.col("end") - F.col("size"))
    passed = F.lit(False)
    for kind in kinds:
        passed = passed | ((F.col("kind") == kind.name) & F.coalesce(F.expr(kind.test), F.lit(False)))
    return placed.where(passed).drop("gap", "size", "number")


def joined(found: Column, order: list[str]) -> Column:
    """`kind:start:end` of an array of spans by start, then kind as listed, then end, comma-joined."""
    keyed = F.transform(found, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, order)), s["kind"]).alias("rank"), s["end"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def duckdb_crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string expression, which DuckDB lacks."""
    bits = "list_reduce(list_prepend(xor(c, b), [0,1,2,3,4,5,6,7]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295)"
