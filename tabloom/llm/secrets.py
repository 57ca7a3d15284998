"""Secrets: strong patterns, and weak parts of one credential that stand in one scope.

Assignments, access keys and long hex runs are reported wherever they are. An identifier, a
secret-like string or an endpoint alone proves nothing. A scope is the text between blank lines.
Parts are joined to the scope interval that holds them: what it tells of each side is where the
side's first span ends and its last one starts, which says whether a part has a complement that
does not overlap it, however far away. Identifiers and endpoints are complements of secrets; an
identifier and an endpoint without a secret are not a credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import Kind, joined, scan, spans

#: The patterns of the strong kinds.
_NAMES = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
STRONG = [
    Kind("assign", rf"""{_NAMES}["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 1, "length(value) >= 6"),
    Kind("access", "AKIA[A-Z0-9]++", test="length(value) >= 20"),
    Kind("hex", "[0-9a-f]{24,}+"),
]
#: Weak parts: an identifier by name or by a short key prefix, a mixed string, an address.
_MIXED = "value rlike '[0-9]' and value rlike '[A-Za-z]'"
WEAK = [
    Kind("weak_id", r"""(?<![A-Za-z0-9])(?:(?i:client|account|access|key|app|user|tenant)[_-]?(?i:id|name)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9._-]{4,}+|AKIA[A-Z0-9]{8,}+)"""),
    Kind("weak_secret", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{16,}+", test=_MIXED),
    Kind("weak_endpoint", r"""(?<![A-Za-z])[Hh][Tt][Tt][Pp][Ss]?://[^\s"'<>]++"""),
]
_BREAK = Kind("break", r"\n[\x20\t\r]*+\n\s*+")
KINDS = [*STRONG, *WEAK, _BREAK]
BASE = [k.name for k in STRONG]
PARTS = [k.name for k in WEAK]
ORDER = [*BASE, *PARTS]
#: What takes each side of a credential; strong spans complement weak ones, too.
IDENTIFIERS, SECRETS, ENDPOINTS = ("weak_id", "access"), ("weak_secret", "assign", "hex"), ("weak_endpoint",)


def _complemented() -> Column:
    """Whether a part's scope holds a complement that lies wholly before or after it."""
    scope = Window.partitionBy("k1", "k2", "scope")

    def apart_from(side: tuple[str, ...]) -> Column:
        of_side = F.col("kind").isin(*side)
        before = F.min(F.when(of_side, F.col("end"))).over(scope) <= F.col("start")
        after = F.max(F.when(of_side, F.col("start"))).over(scope) >= F.col("end")
        return F.coalesce(before | after, F.lit(False))

    secret = F.col("kind").isin(*SECRETS)
    return F.when(secret, apart_from(IDENTIFIERS) | apart_from(ENDPOINTS)).otherwise(apart_from(SECRETS))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row; spans is array<struct<start, end, kind>>, unordered.

    Null texts count as empty and have no spans. Repeated rows all get the same spans; null ids
    are kept. A weak part that overlaps a strong span is not reported again, nor is a secret-like
    piece of an address a secret. Other columns are ignored. An empty table gives an empty result.
    """
    scanned = scan(docs.select(id_col, text_col), KINDS, id_col, text_col, "secrets")
    row = Window.partitionBy("k1", "k2").orderBy("start", "end", "kind")

    def overlapped(by: Column) -> Column:
        before = F.max(F.when(by, F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, -1))
        after = F.min(F.when(by, F.col("start"))).over(row.rowsBetween(1, Window.unboundedFollowing))
        return F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))

    strong = F.col("kind").isin(BASE)
    placed = spans(scanned, KINDS).select("k1", "k2", "start", "end", "kind")
    placed = placed.withColumn("scope", F.sum((F.col("kind") == "break").cast("int")).over(row))
    placed = placed.withColumn("in_strong", overlapped(strong)).withColumn("in_address", overlapped(F.col("kind") == "weak_endpoint"))
    free = strong | (~F.col("in_strong") & ~((F.col("kind") == "weak_secret") & F.col("in_address")))
    parts = placed.where((F.col("kind") != "break") & free).withColumn("linked", _complemented())
    every = parts.where(strong | F.col("linked"))
    per_row = every.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    empty = F.array().cast(per_row.schema["spans"].dataType)
    return scanned.select(id_col, "k1", "k2").join(per_row, ["k1", "k2"], "left").select(id_col, F.coalesce("spans", empty).alias("spans"))


def op2_linked_secrets(spark, sf_dir: str) -> DataFrame:
    """Every document's counts of strong spans, their digest, and all spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base: Column = F.filter("spans", lambda s: s["kind"].isin(BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base, BASE), 256).alias("base_sha256"), joined(F.col("spans"), ORDER).alias("spans"))
