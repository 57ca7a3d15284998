"""Personal data: patterns, and terms that give a protected entity away.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Each distinct value
is a protected entity. A word of a document that holds it reveals the entity as far as meeting
the word narrows the entity down: the pointwise mutual information of the two over the corpus, as a share
of the entity's own information, log(N n(e,w) / n(e) n(w)) / log(N / n(e)). Words beyond a
threshold are generalised to a placeholder; words that give (nearly) all away are removed. Counts
are over all documents; a pair must be seen in several distinct texts before it is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import Kind, joined, row_keys, scan, spans, text_or_empty, written

#: The patterns of the kinds. Runs are possessive and start at the run's beginning
#: (or where the match before ended), which finds the same matches in linear time.
_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_DIGITS = "regexp_replace(value, '[^0-9]', '')"
KINDS = [
    Kind("email", _EMAIL),
    Kind("ip", _IP, test=f"value rlike r'^{_BYTE}(?:[.]{_BYTE}){{3}}$'"),
    Kind("card", _CARD, test=f"length({_DIGITS}) between 12 and 19 and luhn_check({_DIGITS})"),
    Kind("phone", _PHONE, test=f"length({_DIGITS}) between 9 and 15"),
]
BASE = [k.name for k in KINDS]
ORDER = [*BASE, "generalise", "remove"]
#: Share of an entity's information from which a word is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Distinct texts in which an entity and a word must meet.
SUPPORT = 3
_WORD = r"\p{L}{3,}+"
#: Placeholder of each kind in sanitised texts.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}


def _clear(base: DataFrame, terms: DataFrame) -> DataFrame:
    """(k1, k2, start, end, kind) of `base` and of those `terms` that overlap no span of it."""
    columns = ["k1", "k2", "start", "end", "kind"]
    every = base.select(*columns).unionByName(terms.select(*columns))
    is_base = F.col("kind").isin(BASE)
    row = Window.partitionBy("k1", "k2").orderBy("start", "end", "kind")
    before = F.max(F.when(is_base, F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.col("start"))).over(row.rowsBetween(1, Window.unboundedFollowing))
    clear = every.withColumn("before", before).withColumn("after", after)
    return clear.where(is_base | ((F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))).select(*columns)


def _revealing(docs: DataFrame, held: DataFrame, words: DataFrame, text_col: str) -> DataFrame:
    """(entity, word, share): how much of the entity's information the word gives, for pairs with support.

    All counts are of rows and of whole texts; `held` (k1, k2, t, entity, copies) says how many
    rows a distinct one stands for, `words` (k1, k2, word) has the distinct words of its texts.
    """
    total = docs.count()
    meets = held.join(words, ["k1", "k2"])
    texts = meets.groupBy("entity", "word", "t").agg(F.sum("copies").alias("copies"))
    pairs = texts.groupBy("entity", "word").agg(F.sum("copies").alias("both"), F.count(F.lit(1)).alias("texts"))
    pairs = written(pairs.where(F.col("texts") >= SUPPORT).select("entity", "word", "both"), "pii-pairs")
    found = F.regexp_extract_all(text_or_empty(text_col), F.lit(_WORD), F.lit(0))
    every = docs.select(F.explode(F.array_distinct(F.transform(found, lambda w: F.lower(w)))).alias("word"))
    known = every.groupBy("word").agg(F.count(F.lit(1)).alias("word_docs"))
    entities = held.groupBy("entity").agg(F.sum("copies").alias("entity_docs"))
    counted = pairs.join(known, "word").join(entities, "entity")
    information = F.log(F.lit(float(max(total, 1))) / F.col("entity_docs"))
    gained = F.log(F.lit(float(max(total, 1))) * F.col("both") / (F.col("entity_docs") * F.col("word_docs")))
    return counted.where(information > 0).select("entity", "word", (gained / information).alias("share")).where(F.col("share") >= GENERALISE)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, spans) for every row; spans is array<struct<start, end, kind>>, unordered.

    Null texts count as empty and have no spans. Repeated rows all get the same spans; null ids
    are kept. Words that overlap a pattern's span are never replaced on their own. Other columns
    are ignored. An empty table gives an empty result. Only texts of entities that SUPPORT texts
    hold are searched for words: no pair of another entity can have support.
    """
    scanned = scan(docs, KINDS, id_col, text_col, "pii")
    base = spans(scanned, KINDS).withColumn("entity", F.concat(F.col("kind"), F.lit(":"), F.when(F.col("kind") == "email", F.lower("value")).when(F.col("kind") == "ip", F.col("value")).otherwise(F.expr(_DIGITS))))
    base = written(base.drop("value"), "pii-base")
    seen = base.select("entity", "t").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT).select("entity")
    copies = scanned.where(F.size("found") > 0).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    held = written(base.select("k1", "k2", "t", "entity").distinct().join(seen, "entity").join(copies, ["k1", "k2"]), "pii-held")
    rows = held.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    here = [k == F.col(n) for k, n in zip(row_keys(id_col, text_or_empty(text_col)), ("_k1", "_k2"), strict=True)]
    texts = docs.select(id_col, text_col).join(rows, here[0] & here[1], "left_semi")
    kind = [Kind("word", _WORD)]
    words = written(spans(scan(texts, kind, id_col, text_col, "pii-texts"), kind).withColumn("word", F.lower("value")).drop("value"), "pii-words")
    revealing = _revealing(docs, held, words.select("k1", "k2", "word").distinct(), text_col)
    shares = held.join(revealing, "entity").groupBy("k1", "k2", "word").agg(F.max("share").alias("share"))
    terms = words.drop("kind").join(shares, ["k1", "k2", "word"]).select("k1", "k2", "start", "end", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("kind"))
    per_row = _clear(base, terms).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    empty = F.array().cast(per_row.schema["spans"].dataType)
    return scanned.select(id_col, "k1", "k2").join(per_row, ["k1", "k2"], "left").select(id_col, "k1", "k2", F.coalesce("spans", empty).alias("spans"))


def _sanitised(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind's label; overlapping spans give one label, the first's."""
    ordered = F.array_sort(found)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > s["start"]), wider).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(ordered, empty, merge)
    label = F.create_map(*[x for pair in LABELS.items() for x in map(F.lit, pair)])
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["end"]))
    pieces = F.transform(merged, lambda s, i: F.concat(F.substring(text, F.get(starts, i).cast("int") + 1, (s["start"] - F.get(starts, i)).cast("int")), label[s["kind"]]))
    tail = F.substring(text, F.element_at(starts, -1).cast("int") + 1, F.length(text))
    return F.concat(F.array_join(pieces, ""), tail)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span of `find` replaced in `text_col`; a text without spans stays as it is, null included.

    Repeated rows and null ids stay, each with its own text's spans; other columns pass unchanged
    whatever their names. An empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    found = find(docs, id_col, text_col).where(F.size("spans") > 0).dropDuplicates(["k1", "k2"]).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("spans").alias("_spans"))
    keyed = docs.select(F.struct("*").alias("_doc"), *[k.alias(n) for k, n in zip(row_keys(id_col, text), ("_row1", "_row2"), strict=True)])
    both = keyed.join(found, (F.col("_row1") == F.col("_k1")) & (F.col("_row2") == F.col("_k2")), "left")
    before = F.col("_doc")[text_col]
    new = F.when(F.col("_spans").isNull(), before).otherwise(_sanitised(before, F.col("_spans")))
    return both.select(*[(new if c == text_col else F.col("_doc")[c]).alias(c) for c in docs.columns])


def op9_information_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's counts of pattern spans, their digest, and all spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base, BASE), 256).alias("base_sha256"), joined(F.col("spans"), ORDER).alias("spans"))
