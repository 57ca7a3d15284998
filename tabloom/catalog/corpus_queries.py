"""Extraction, cleaning, identity and deduplication of tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.catalog import sqlparts as S
from tabloom.functions import ids
from tabloom.model import ORDER_COLUMNS, order_cells, order_rows, order_tables
from tabloom.operators import dedup, extract
from tabloom.registry import query, read


def order_pages(spark, folder, infobox=False):
    """Orders rendered as web pages, so that HTML extraction has tables to find.

    Every line of an order is a table row; hidden sort keys, line breaks and spans
    are woven in. The infobox form has one key/value row per column instead.
    """
    def td(tag, c):
        return F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))

    rows = order_rows(spark, folder)
    if infobox:
        first = rows.where("row = 0")
        parts = [F.concat(F.lit("<tr>"), td("th", F.lit(n)), td("td", F.col(n)), F.lit("</tr>")) for n in ORDER_COLUMNS]
        page = F.concat(
            F.lit('<html><TABLE class="infobox vevent"><tr><th colspan="2">Order '), "table_id", F.lit("</th></tr>"), *parts, F.lit("</TABLE></html>")
        )
        return first.select(F.col("table_id").alias("page_id"), page.alias("html"))
    hidden = F.concat(F.lit('<td><span style="display:none">key '), F.col("row").cast("string"), F.lit("</span>"), F.col("l_quantity"), F.lit("</td>"))
    line = F.concat(
        F.lit("<tr>"), hidden, *[td("td", F.col(c)) for c in ORDER_COLUMNS[1:6]],
        F.lit('<td rowspan="2">'), F.replace("l_shipdate", F.lit("-"), F.lit("<br />")), F.lit("</td></tr>"),
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", line.alias("h")))), lambda r: r["h"]), "\n")
    head = "".join(f"<th>{c}</th>" for c in ORDER_COLUMNS)
    page = F.concat(F.lit(f"<html><p>é &amp; ü</p></table><Table><tr>{head}</tr>"), body, F.lit("</table><p>end</p></html>"))
    # Parsing is heavy for its bytes, so the pages keep one partition per core.
    pages = rows.groupBy("table_id").agg(page.alias("html")).withColumnRenamed("table_id", "page_id")
    return pages.repartition(spark.sparkContext.defaultParallelism)


_PAGE_TEXT = "CASE WHEN col = 6 AND row >= 0 THEN replace(text, '-', ' ') ELSE text END"


@query(
    "b01_table_spans",
    f"""{S.WITH_OT}, r AS (SELECT table_id, row, '<tr><td><span style="display:none">key ' || row || '</span>' || c0 || '</td>' || '<td>' || c1 || '</td><td>' || c2 || '</td><td>' || c3 || '</td><td>' || c4 || '</td><td>' || c5 || '</td><td rowspan="2">' || replace(c6, '-', '<br />') || '</td></tr>' AS h FROM ot_rows),
    p AS (SELECT table_id, sum(length(h)) + count(*) - 1 AS l FROM r GROUP BY table_id)
    SELECT table_id AS page_id, CAST(0 AS INTEGER) AS table_ix, CAST(32 AS INTEGER) AS begin_ix, CAST(32 + 7 + 9 + 7 * 9 + length('l_quantityl_extendedpricel_discountl_taxl_returnflagl_linestatusl_shipdate') + l + 8 AS INTEGER) AS end_ix FROM p""",
)
def b01(spark, folder):
    spans = extract.element_spans(order_pages(spark, folder))
    return spans.select("page_id", F.col("ix").alias("table_ix"), F.col("begin").alias("begin_ix"), F.col("end").alias("end_ix"))


_TAG = "'(?i)<p|</p>'"


@query(
    "b01_given_spans",
    f"""WITH pieces AS (SELECT page_id, unnest(string_split_regex(html, {_TAG})) AS gap, unnest(list_append(regexp_extract_all(html, {_TAG}), '')) AS tag, generate_subscripts(list_append(regexp_extract_all(html, {_TAG}), ''), 1) AS n FROM pages),
    tags AS (SELECT page_id, n, tag, CASE WHEN tag[2] = '/' THEN -1 ELSE 1 END AS step, sum(strlen(gap) + strlen(tag)) OVER (PARTITION BY page_id ORDER BY n) AS stop FROM pieces WHERE tag IS NOT NULL),
    pairs AS (SELECT o.page_id, o.stop - 2 AS begin_ix, c.stop, sum(c.step) OVER (PARTITION BY o.page_id, o.n ORDER BY c.n) AS depth
      FROM tags o JOIN tags c ON o.page_id = c.page_id AND o.step = 1 AND o.tag <> '' AND c.tag <> '' AND c.n >= o.n),
    spans AS (SELECT page_id, begin_ix, min(stop) AS end_ix FROM pairs WHERE depth = 0 GROUP BY ALL)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY begin_ix) - 1 AS INTEGER) AS ix, CAST(begin_ix AS INTEGER) AS begin_ix, CAST(end_ix AS INTEGER) AS end_ix FROM spans""",
)
def b01_given(spark, folder):
    """All paragraphs of the given pages, which often lack their end: what is closed last was opened last."""
    spans = extract.element_spans(read(spark, folder, "pages"), "p")
    return spans.select("page_id", "ix", F.col("begin").alias("begin_ix"), F.col("end").alias("end_ix"))


@query(
    "b02_page_cells",
    f"{S.WITH_OT} SELECT table_id AS page_id, row, col, {_PAGE_TEXT} AS text FROM ot_cells",
)
def b02(spark, folder):
    return extract.page_cells(order_pages(spark, folder)).select("page_id", "row", "col", "text")


@query(
    "b02_given_pages",
    "SELECT count(*) AS n_pages, 0 AS n_tables FROM pages",
)
def b02_pages(spark, folder):
    """The given pages hold no tables; all of them are scanned."""
    pages = read(spark, folder, "pages").select("page_id", "html")
    tables = extract.page_cells(pages).select("page_id", "table_ix").distinct().groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.join(tables, "page_id", "left").agg(
        F.count("*").alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("n_tables")
    )


def flag_cells(spark, folder):
    """Two columns only, so that many rows repeat one text."""
    key = F.col("table_id").cast("bigint")
    cells = order_cells(spark, folder).where("col IN (4, 5)")
    same = (F.col("col") == 5) & (F.col("row") >= 0) & ((F.col("row") + key) % 3 > 0)
    return cells.withColumn("text", F.when(same, F.lit("N")).otherwise(F.col("text")))


@query(
    "b03_standard_tables",
    f"""{S.WITH_OT}, f AS (SELECT table_id, row, c4 = CASE WHEN (row + CAST(table_id AS BIGINT)) % 3 > 0 THEN 'N' ELSE c5 END AS flat FROM ot_rows)
    SELECT table_id FROM f GROUP BY table_id HAVING NOT (coalesce(count_if(flat), 0) > count(*) / 2 - 1)""",
)
def b03(spark, folder):
    return extract.standard_tables(flag_cells(spark, folder))


@query(
    "b04_infobox",
    f"""{S.WITH_OT}, v AS (SELECT table_id, unnest([0,1,2,3,4,5,6,7]) AS col, unnest(['', 'l_quantity','l_extendedprice','l_discount','l_tax','l_returnflag','l_linestatus','l_shipdate']) AS h,
      unnest(['Order ' || table_id, c0, c1, c2, c3, c4, c5, c6]) AS t FROM ot_rows WHERE row = 0)
    SELECT table_id AS page_id, CAST(-1 AS INTEGER) AS row, CAST(col AS INTEGER) AS col, h AS text FROM v UNION ALL SELECT table_id, 0, col, t FROM v""",
)
def b04(spark, folder):
    cells = extract.page_cells(order_pages(spark, folder, infobox=True)).where("infobox")
    return extract.transpose_infoboxes(cells, ["page_id", "table_ix"]).select("page_id", "row", F.col("col").cast("int").alias("col"), "text")


@query(
    "b05_rectangular",
    f"""{S.WITH_OT}, c AS (SELECT * FROM ot_cells WHERE NOT (col = 6 AND row = 2 AND CAST(table_id AS BIGINT) % 2 = 0)), r AS (SELECT table_id, row, count(*) AS n FROM c GROUP BY ALL)
    SELECT table_id FROM r GROUP BY table_id HAVING min(n) = max(n)""",
)
def b05(spark, folder):
    gap = (F.col("col") == 6) & (F.col("row") == 2) & (F.col("table_id").cast("bigint") % 2 == 0)
    return extract.rectangular(order_cells(spark, folder).where(~gap))


@query("b06_fill_ids", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'k' || doc_id ELSE source END AS table_id FROM documents")
def b06(spark, folder):
    key = F.concat(F.lit("k"), F.col("doc_id").cast("string"))
    table_id = F.when(F.col("doc_id") % 6 == 0, "").when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source"))
    records = read(spark, folder, "documents").select("doc_id", key.alias("key"), table_id.alias("table_id"))
    return extract.fill_ids(records, "key", "table_id").select("doc_id", "table_id")


@query("b07_min_size", f"{S.WITH_OT} SELECT table_id, n_rows FROM ot_tables WHERE n_rows >= 3")
def b07(spark, folder):
    return extract.at_least(order_tables(spark, folder), 3, 2).select("table_id", "n_rows")


@query("b08_duplicate", f"{S.WITH_OT} SELECT table_id || '_' || k AS table_id, n_rows FROM ot_tables, (SELECT unnest([0,1,2]) AS k)")
def b08(spark, folder):
    return extract.duplicate(order_tables(spark, folder).select("table_id", "n_rows"), "table_id", 3)


@query("b09_blank_tables", f"{S.WITH_OT} SELECT table_id, CAST(1 AS INTEGER) AS n_rows, CAST(1 AS INTEGER) AS n_cols, '' AS header, '' AS cell FROM ot_tables")
def b09(spark, folder):
    blank = extract.blank_tables(order_tables(spark, folder))
    return blank.select("table_id", "n_rows", "n_cols", F.col("columns")[0].alias("header"), F.col("cells")[0][0].alias("cell"))


@query(
    "b10_shard_rows",
    f"""WITH RECURSIVE {S.OT}, shards AS (
      SELECT table_id, CAST(0 AS BIGINT) AS b, CAST(n_rows AS BIGINT) AS e FROM ot_tables WHERE n_rows >= 2
      UNION ALL SELECT table_id, CASE WHEN side = 0 THEN b ELSE b + (e - b) // 2 END, CASE WHEN side = 0 THEN b + (e - b) // 2 ELSE e END
      FROM shards, (SELECT unnest([0, 1]) AS side) WHERE e - b > 3)
    SELECT c.table_id, CAST(b AS INTEGER) AS shard_begin, CAST(e AS INTEGER) AS shard_end, CAST(row - b AS INTEGER) AS row, col, text
    FROM shards s JOIN ot_body c ON c.table_id = s.table_id AND row >= b AND row < e WHERE e - b BETWEEN 2 AND 3""",
)
def b10(spark, folder):
    return extract.shard_rows(order_tables(spark, folder), order_cells(spark, folder), max_cells=21)


def _sql_seed(text):
    return f"({S.sha_limbs(chr(39)*4 + ' || ' + text + ' || ' + chr(39)*4, 8)} % 4294967295)"


@query("b11_rekey", f"{S.WITH_OT} SELECT table_id, printf('0x%x', CAST({_sql_seed('table_id')} AS BIGINT)) AS new_id FROM ot_tables")
def b11(spark, folder):
    return order_tables(spark, folder).select("table_id", extract.rekey(F.col("table_id")).alias("new_id"))


@query(
    "b12_retrieval_sentences",
    rf"""WITH r AS (SELECT printf('0x%x', CAST({_sql_seed("CAST(doc_id AS VARCHAR)")} AS BIGINT)) AS record_id, source AS title, unnest(string_split(text, chr(10))) AS p FROM documents WHERE source <> 'src0'),
    s AS (SELECT record_id, title, unnest(list_filter(string_split(regexp_replace(trim(p), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS sentence FROM r)
    SELECT DISTINCT record_id, title, md5(sentence) AS digest FROM s WHERE len(regexp_extract_all(lower(sentence), '([\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+)')) BETWEEN 4 AND 32""",
)
def b12(spark, folder):
    title = F.when(F.col("source") != "src0", F.col("source"))
    records = read(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("record_id"), title.alias("title"), "text")
    return extract.retrieval_sentences(records).select("record_id", "title", F.md5("sentence").alias("digest"))


@query("b13_scrub", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5('') ELSE md5(text) END AS digest FROM documents")
def b13(spark, folder):
    raw = F.encode("text", "UTF-8")
    broken = F.when(F.col("doc_id") % 5 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return read(spark, folder, "documents").select("doc_id", F.md5(extract.scrub(broken).cast("binary")).alias("digest"))


@query(
    "b15_blank_questions",
    "SELECT d.doc_id AS table_id, coalesce('q' || item_id, 'FAKE') AS question_id, md5(coalesce(b.text, '')) AS digest FROM documents d LEFT JOIN benchmark b ON item_id = d.doc_id",
)
def b15(spark, folder):
    tables = read(spark, folder, "documents").select(F.col("doc_id").alias("table_id"))
    questions = read(spark, folder, "benchmark").select(
        F.col("item_id").alias("table_id"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"), "text"
    )
    return extract.with_blank_questions(tables, questions).select("table_id", "question_id", F.md5("text").alias("digest"))


@query(
    "h17_table_fingerprint",
    f"""{S.WITH_OT}, j AS (SELECT table_id, string_agg(lower(text), '###' ORDER BY row, col) AS t FROM ot_cells GROUP BY table_id)
    SELECT table_id, document_title || '_' || printf('%X', CAST({S.fp64('t')} AS UBIGINT)) AS content_id FROM j JOIN ot_tables USING (table_id)""",
)
def h17(spark, folder):
    return extract.table_fingerprints(order_cells(spark, folder), order_tables(spark, folder)).select("table_id", "content_id")


@query(
    "c11_random_pairs",
    f"""{S.WITH_OT}, d AS (SELECT table_id AS key, document_title AS table_id, CASE WHEN {_sql_seed('document_title')} % 5 = 0 THEN 'test' ELSE 'train' END AS split, sha256('0|' || table_id) AS h FROM ot_tables),
    n AS (SELECT *, coalesce(lead(table_id) OVER ring, first_value(table_id) OVER ring) AS other FROM d WINDOW ring AS (PARTITION BY split ORDER BY h, key))
    SELECT key, table_id, split, CASE WHEN other <> table_id THEN other END AS random_table_id FROM n""",
)
def c11(spark, folder):
    records = order_tables(spark, folder).select(F.col("table_id").alias("key"), F.col("document_title").alias("table_id"))
    return extract.random_pairs(records, n_shards=5)


@query("j14_split_by_table", f"{S.WITH_OT} SELECT table_id, CASE WHEN {_sql_seed('table_id')} % 20 = 0 THEN 'test' ELSE 'train' END AS split FROM ot_tables")
def j14(spark, folder):
    return order_tables(spark, folder).select("table_id", extract.split_of(F.col("table_id"), 20).alias("split"))


@query(
    "j15_split_by_title",
    f"{S.WITH_OT} SELECT table_id, CASE WHEN n_rows > 6 THEN 'test' WHEN {S.uniform('document_title')} < 0.9 THEN 'train' ELSE 'dev' END AS split FROM ot_tables",
)
def j15(spark, folder):
    original = F.when(F.col("n_rows") > 6, "dev").otherwise("train")
    return order_tables(spark, folder).select("table_id", extract.split_by_title(original, F.col("document_title")).alias("split"))


@query(
    "j16_resample",
    f"""WITH r AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 0.25 WHEN 'fr' THEN 2.5 WHEN 'de' THEN 3.0 ELSE 1.0 END AS rate, {S.uniform('CAST(doc_id AS VARCHAR)')} AS u FROM documents),
    c AS (SELECT doc_id, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r)
    SELECT doc_id, copies, CAST(unnest(range(copies)) AS INTEGER) AS copy FROM c WHERE copies > 0""",
)
def j16(spark, folder):
    rates = spark.createDataFrame([("en", 0.25), ("fr", 2.5), ("de", 3.0)], "lang string, rate double")
    docs = read(spark, folder, "documents").select("doc_id", "lang")
    return extract.resample(docs, "doc_id", rates, ["lang"]).select("doc_id", "copies", "copy")


# ---- deduplication.


def dedup_tables(spark, folder):
    return order_tables(spark, folder).withColumn("urls", F.array("document_url"))


VECTORS = r"""
rt AS (SELECT table_id, row, string_split(string_agg(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ' ORDER BY col), ' ') AS t FROM ot_cells GROUP BY ALL),
gr AS (SELECT table_id, array_to_string(t[i:i + n - 1], ' ') AS gram FROM (SELECT table_id, t, unnest(range(1, len(t) + 1)) AS i FROM rt), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE i + n - 1 <= len(t)),
bc AS (SELECT table_id, CAST(CAST('0x' || substr(sha256(gram), 58, 7) AS BIGINT) % 2048 AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS n FROM gr GROUP BY ALL),
nv AS (SELECT table_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY table_id))::DOUBLE AS w FROM bc),
edge AS (SELECT x.table_id AS a, y.table_id AS b, round(sum(u.w * v.w), 9) AS sim FROM ot_tables x JOIN ot_tables y ON x.document_title = y.document_title AND x.table_id < y.table_id
  AND abs(x.n_rows - y.n_rows) <= 2 AND x.document_url <> y.document_url JOIN nv u ON u.table_id = x.table_id JOIN nv v ON v.table_id = y.table_id AND u.bucket = v.bucket GROUP BY ALL HAVING round(sum(u.w * v.w), 9) >= {t})
"""


@query("i06_bucket_counts", f"{S.WITH_OT}, {VECTORS.replace('{t}', '0.91')} SELECT table_id, count(*) AS n_buckets, CAST(sum(n) AS BIGINT) AS n_grams, CAST(sum(bucket * n) AS BIGINT) AS weighted FROM bc GROUP BY table_id")
def i06(spark, folder):
    counts = dedup.bucket_counts(order_cells(spark, folder))
    return counts.groupBy("table_id").agg(
        F.count("*").alias("n_buckets"), F.sum("n").alias("n_grams"), F.sum(F.col("bucket") * F.col("n")).alias("weighted")
    )


@query("i07_similarity_edges", f"{S.WITH_OT}, {VECTORS.replace('{t}', '0.6')} SELECT a, b, round(sim, 6) AS sim FROM edge")
def i07_edges(spark, folder):
    """Orders differ in most numbers, so the threshold is lower than the default."""
    edges = dedup.similarity_edges(dedup_tables(spark, folder), order_cells(spark, folder), threshold=0.6)
    return edges.withColumn("sim", F.round("sim", 6))


@query("i07_group_similar")
def i07(spark, folder):
    """Clusters are checked against a sequential merge on small fixtures in the tests."""
    return dedup.group_similar(dedup_tables(spark, folder), order_cells(spark, folder), threshold=0.6)


@query(
    "c14_compatible",
    f"""{S.WITH_OT}, p AS (SELECT table_id AS a, lead(table_id) OVER (PARTITION BY document_title ORDER BY CAST(table_id AS BIGINT)) AS b FROM ot_tables)
    SELECT a, b FROM p JOIN ot_tables x ON x.table_id = a JOIN ot_tables y ON y.table_id = b WHERE abs(x.n_rows - y.n_rows) <= 2 AND x.document_url <> y.document_url""",
)
def c14(spark, folder):
    tables = dedup_tables(spark, folder)
    order = Window.partitionBy("document_title").orderBy(F.col("table_id").cast("bigint"))
    pairs = tables.select(F.col("table_id").alias("a"), F.lead("table_id").over(order).alias("b")).where("b IS NOT NULL")
    return dedup.compatible(pairs, tables)


@query(
    "d06_merge_groups",
    f"""{S.WITH_OT}, g AS (SELECT document_title AS cluster, arg_min(table_id, (-version, table_id)) AS table_id, arg_min(document_url, (-version, table_id)) AS document_url,
        list_sort(list_distinct(list(document_url))) AS urls, list_sort(list(table_id)) AS ids FROM ot_tables GROUP BY document_title)
    SELECT table_id, document_url, array_to_string(list_filter(urls, lambda u: u <> document_url), '|') AS alt_urls, array_to_string(list_filter(ids, lambda i: i <> table_id), '|') AS alt_ids FROM g""",
)
def d06(spark, folder):
    tables = order_tables(spark, folder).select(
        F.col("document_title").alias("cluster"), "table_id", "document_url", ids.url_version(F.col("document_url")).alias("version")
    )
    merged = dedup.merge_groups(tables)
    return merged.select("table_id", "document_url", F.array_join("alt_urls", "|").alias("alt_urls"), F.array_join("alt_ids", "|").alias("alt_ids"))
