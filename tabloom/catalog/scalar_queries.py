"""Scalar functions applied to whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog import sqlparts as S
from tabloom.functions import hashing, ids, numbers, text
from tabloom.model import body, order_cells
from tabloom.registry import query, read


def _docs(spark, folder):
    return read(spark, folder, "documents")


@query(
    "h01_normalize_for_match",
    f"SELECT doc_id, md5({S.squeeze('lower(text)')}) AS digest FROM documents",
)
def h01(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(text.normalize_for_match(F.col("text"))).alias("digest"))


@query("h02_format_text", f"SELECT doc_id, md5({S.format_text('text')}) AS digest FROM documents")
def h02(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(text.format_text(F.col("text"))).alias("digest"))


@query(
    "h03_tokenize",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)', 1) AS toks,
              list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents)
    SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(ws) AS INTEGER) AS n_words,
      md5(array_to_string(toks, '|')) AS digest FROM t""",
)
def h03(spark, folder):
    toks = text.tokenize(F.col("text"))
    return _docs(spark, folder).select(
        "doc_id",
        F.size(toks).alias("n_tokens"),
        F.size(text.words(F.col("text"))).alias("n_words"),
        F.md5(F.array_join(toks, "|")).alias("digest"),
    )


@query(
    "h04_fold_answer",
    r"""WITH a AS (SELECT conv_id, turn, strip_accents(replace(replace(text, '’', ''''), '–', '-')) AS t FROM conversations),
    b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(trim(t), '^"([^"]*)"$', '\1'), '\.$', '') AS t FROM a)
    SELECT conv_id, turn, md5(regexp_replace(trim(lower(regexp_replace(t, '\s+', ' ', 'g'))), '<[^<]+?>', '', 'g')) AS digest FROM b""",
)
def h04(spark, folder):
    return read(spark, folder, "conversations").select(
        "conv_id", "turn", F.md5(text.fold_answer(F.col("text"))).alias("digest")
    )


_LADDER = """
  CASE WHEN contains(t, ',') AND (contains(t, '.') OR len(list_filter(string_split(t, ','), lambda p: length(p) = 3)) > 0)
         THEN TRY_CAST(replace(t, ',', '') AS DOUBLE)
       WHEN len(string_split(t, ',')) = 2 THEN TRY_CAST(replace(t, ',', '.') AS DOUBLE)
       WHEN len(string_split(t, '.')) > 2 THEN TRY_CAST(replace(t, '.', '') AS DOUBLE)
       WHEN len(string_split(t, ',')) > 2 THEN TRY_CAST(replace(t, ',', '') AS DOUBLE)
       ELSE TRY_CAST(t AS DOUBLE) END
"""


@query(
    "h05_convert_to_float",
    f"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(props || ' ' || value || ' 1,' || event_id, '[^0-9.,]+')) AS t FROM events),
    u AS (SELECT t FROM w UNION SELECT DISTINCT unnest([replace(t, '.', ','), t || '.5.5', '1,' || t, 'x' || t]) FROM w)
    SELECT t AS text, {_LADDER} AS number FROM u""",
)
def h05(spark, folder):
    raw = F.concat_ws("", F.col("props"), F.lit(" "), F.col("value").cast("string"), F.lit(" 1,"), F.col("event_id").cast("string"))
    found = read(spark, folder, "events").select(F.explode(F.split(raw, "[^0-9.,]+")).alias("text")).distinct()
    t = F.col("text")
    variants = found.select(
        F.explode(
            F.array(
                t, F.replace(t, F.lit("."), F.lit(",")), F.concat(t, F.lit(".5.5")), F.concat(F.lit("1,"), t), F.concat(F.lit("x"), t)
            )
        ).alias("text")
    ).distinct()
    return variants.select("text", numbers.convert_to_float(t).alias("number"))


@query(
    "h06_normalize_answers",
    r"""SELECT conv_id, md5(array_to_string(list_sort(list(lower(text))), '|')) AS digest FROM conversations GROUP BY conv_id""",
)
def h06(spark, folder):
    return (
        read(spark, folder, "conversations")
        .groupBy("conv_id")
        .agg(F.md5(F.array_join(text.normalize_answers(F.collect_list("text")), "|")).alias("digest"))
    )


@query("h07_normalize_qa_answer", f"SELECT doc_id, md5({S.qa_answer('text')}) AS digest FROM documents")
def h07(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(text.normalize_qa_answer(F.col("text"))).alias("digest"))


@query(
    "h08_all_spans",
    r"""WITH p AS (SELECT item_id, text, regexp_extract_all(text, '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)', 1) AS ps FROM benchmark),
    e AS (SELECT item_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p),
    o AS (SELECT item_id, piece, sum(length(piece)) OVER (PARTITION BY item_id ORDER BY i) AS stop, i FROM e),
    w AS (SELECT item_id, stop - length(piece) AS start, stop, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k
          FROM o WHERE regexp_matches(piece, '^[\p{L}\p{N}]'))
    SELECT a.item_id, CAST(a.start AS INTEGER) AS begin_ix, CAST(b.stop AS INTEGER) AS end_ix
    FROM w a JOIN w b ON a.item_id = b.item_id AND b.k BETWEEN a.k AND a.k + 4""",
)
def h08(spark, folder):
    return (
        read(spark, folder, "benchmark")
        .select("item_id", F.explode(text.all_spans(F.col("text"), 5)).alias("s"))
        .select("item_id", F.col("s.begin").alias("begin_ix"), F.col("s.end").alias("end_ix"))
    )


@query(
    "h09_token_substring",
    r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: w IN ('the', 'la', 'die', 'el'))) AS INTEGER) AS n_hits FROM documents""",
)
def h09(spark, folder):
    counts = sum(text.count_token_matches(F.col("text"), F.lit(w)) for w in ("the", "la", "die", "el"))
    return _docs(spark, folder).select("doc_id", counts.alias("n_hits"))


@query(
    "h10_identifiers",
    """SELECT conv_id, turn, conv_id || '-' || role || '_' || turn AS question_id, CAST(conv_id AS VARCHAR) AS example_id,
      role AS annotator, CAST(turn AS INTEGER) AS position, conv_id || '-' || role AS interaction_id,
      conv_id || '/' || turn || '-0' AS candidate_id, 'EMPTY-0_0' AS padding_id FROM conversations""",
)
def h10(spark, folder):
    qid = ids.question_id(ids.sequence_id(F.col("conv_id"), F.col("role")), F.col("turn"))
    parsed = ids.parse_question_id(F.col("question_id"))
    candidate = ids.candidate_id(F.col("conv_id").cast("string"), F.col("turn"))
    return (
        read(spark, folder, "conversations")
        .withColumn("question_id", qid)
        .select(
            "conv_id",
            "turn",
            "question_id",
            ids.example_id(candidate).alias("example_id"),
            parsed["annotator"].alias("annotator"),
            parsed["position"].alias("position"),
            ids.interaction_of_question(F.col("question_id")).alias("interaction_id"),
            candidate.alias("candidate_id"),
            ids.padding_question_id().alias("padding_id"),
        )
    )


@query("h12_float32", "SELECT event_id, CAST(CAST(CAST(value AS FLOAT) AS DOUBLE) AS DOUBLE) AS value32 FROM events")
def h12(spark, folder):
    return read(spark, folder, "events").select("event_id", numbers.to_float32(F.col("value")).cast("double").alias("value32"))


@query(
    "h13_parse_number",
    S.WITH_OT
    + r""" SELECT text, TRY_CAST(replace(regexp_replace(text, '(st|nd|rd|th)$', ''), ',', '') AS DOUBLE) AS number, count(*) AS n
    FROM (SELECT text FROM ot_body UNION ALL SELECT text || 'th' FROM ot_body UNION ALL SELECT '1,' || text FROM ot_body)
    GROUP BY text""",
)
def h13(spark, folder):
    cells = body(order_cells(spark, folder, with_header=False)).select("text")
    t = F.col("text")
    variants = cells.select(F.explode(F.array(t, F.concat(t, F.lit("th")), F.concat(F.lit("1,"), t))).alias("text"))
    return variants.groupBy("text").agg(F.count("*").alias("n")).select("text", numbers.parse_number(t).alias("number"), "n")


@query(
    "h14_parse_date",
    r"""WITH d AS (SELECT DISTINCT o_orderdate AS d FROM orders),
    v AS (SELECT d, unnest([strftime(d, '%Y-%m-%d'), strftime(d, '%-d %B %Y'), strftime(d, '%B %-d, %Y'), strftime(d, '%d.%m.%Y'),
      strftime(d, '%m-%d-%Y'), strftime(d, '%b %Y'), strftime(d, '%Y-%m'), strftime(d, '%Ys'), nullif(strftime(d, '%d %b'), '29 Feb'), strftime(d, '%B')]) AS text,
      unnest([7,7,7,7,7,6,6,4,3,2]) AS mask FROM d)
    SELECT DISTINCT text, CASE WHEN mask & 4 > 0 THEN CAST(year(d) AS INTEGER) END AS y,
      CASE WHEN mask & 2 > 0 THEN CAST(month(d) AS INTEGER) END AS m,
      CASE WHEN mask & 1 > 0 THEN CAST(day(d) AS INTEGER) END AS dom FROM v WHERE text IS NOT NULL
    UNION ALL SELECT '29 Feb', NULL, NULL, NULL -- no such day in the default year""",
)
def h14(spark, folder):
    d = F.col("o_orderdate")
    formats = (
        "yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "dd.MM.yyyy", "MM-dd-yyyy", "MMM yyyy", "yyyy-MM", "yyyy's'", "dd MMM", "MMMM",
    )
    texts = F.explode(F.array(*[F.date_format(d, f) for f in formats]))
    parsed = numbers.parse_date(F.col("text"))
    return (
        read(spark, folder, "orders")
        .select("o_orderdate")
        .distinct()
        .select(texts.alias("text"))
        .distinct()
        .select("text", parsed["year"].alias("y"), parsed["month"].alias("m"), parsed["day"].alias("dom"))
    )


@query(
    "h15_value_spans",
    r"""WITH n AS (SELECT event_id, props, regexp_extract(props, '[0-9]+') AS d FROM events)
    SELECT event_id, CAST(strpos(props, d) - 1 AS INTEGER) AS begin_ix, CAST(strpos(props, d) - 1 + length(d) AS INTEGER) AS end_ix,
      CAST(d AS DOUBLE) AS number FROM n WHERE d <> ''""",
)
def h15(spark, folder):
    return (
        read(spark, folder, "events")
        .select("event_id", F.explode(numbers.value_spans(F.col("props"))).alias("s"))
        .select(
            "event_id",
            F.col("s.begin").alias("begin_ix"),
            F.col("s.end").alias("end_ix"),
            F.col("s.values")[0]["f"].alias("number"),
        )
    )


@query("h15_value_spans_documents")
def h15_documents(spark, folder):
    """Numbers and dates in running text, per document and kind."""
    spans = _docs(spark, folder).select("doc_id", F.explode(numbers.text_values(text.normalize_for_match(F.col("text")))).alias("v"))
    return spans.groupBy("doc_id", F.col("v.type").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "h16_fingerprint",
    f"""SELECT doc_id, CAST({S.fp64('text')} AS VARCHAR) AS fp64, CAST({S.sha_limbs('text', 8)} % 4294967295 AS BIGINT) AS fp32,
      CAST(CAST('0x' || substr(sha256(text), 58, 7) AS BIGINT) % 2048 AS INTEGER) AS bucket FROM documents""",
)
def h16(spark, folder):
    t = F.col("text")
    return _docs(spark, folder).select(
        "doc_id",
        hashing.fingerprint64(t).cast("string").alias("fp64"),
        hashing.fingerprint32(t).alias("fp32"),
        hashing.hash_bucket(t).alias("bucket"),
    )


@query("h18_hash_uniform", f"SELECT doc_id, round({S.uniform('text')}, 9) AS u FROM documents")
def h18(spark, folder):
    return _docs(spark, folder).select("doc_id", F.round(hashing.hash_uniform(F.col("text")), 9).alias("u"))


@query(
    "h19_is_ordinal",
    r"""WITH w AS (SELECT DISTINCT unnest([CAST(l_linenumber AS VARCHAR) || 'th', CAST(l_partkey AS VARCHAR) || 'st',
      CAST(l_linenumber AS VARCHAR), l_returnflag || 'nd', 'first', '0th']) AS text FROM lineitem)
    SELECT text, text = 'first' OR (regexp_matches(text, '^[0-9]+(st|nd|rd|th)$') AND NOT regexp_matches(text, '^0+[a-z]')) AS ordinal FROM w""",
)
def h19(spark, folder):
    line, part = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    variants = F.array(
        F.concat(line, F.lit("th")), F.concat(part, F.lit("st")), line, F.concat("l_returnflag", F.lit("nd")), F.lit("first"), F.lit("0th")
    )
    return (
        read(spark, folder, "lineitem")
        .select(F.explode(variants).alias("text"))
        .distinct()
        .select("text", numbers.is_ordinal(F.col("text")).alias("ordinal"))
    )


@query(
    "h20_url_version",
    r"""SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)(&|#|$)', 1), '') AS BIGINT), 0) AS version FROM pages""",
)
def h20(spark, folder):
    return read(spark, folder, "pages").select("page_id", ids.url_version(F.col("url"), "page").alias("version"))


@query(
    "h21_sentences",
    r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss
      FROM documents)
    SELECT doc_id, CAST(len(ss) AS INTEGER) AS n_sentences, md5(array_to_string(ss, '|')) AS digest FROM s""",
)
def h21(spark, folder):
    parts = text.sentences(F.col("text"))
    return _docs(spark, folder).select(
        "doc_id", F.size(parts).alias("n_sentences"), F.md5(F.array_join(parts, "|")).alias("digest")
    )


@query(
    "h22_entity_title",
    """SELECT p_partkey, url_decode(replace(string_split('/wiki/' || p_brand || '/' || replace(url_encode(p_name), '%20', '_'), '/')[-1], '_', ' ')) AS title FROM part""",
)
def h22(spark, folder):
    link = F.concat(F.lit("/wiki/"), F.col("p_brand"), F.lit("/"), F.replace(F.url_encode("p_name"), F.lit("+"), F.lit("_")))
    return read(spark, folder, "part").select("p_partkey", ids.entity_title(link).alias("title"))


@query(
    "h23_format_number",
    """SELECT event_id, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%.2f', v) END AS shown
    FROM (SELECT event_id, unnest([value, floor(value), value / 8]) AS v FROM events)""",
)
def h23(spark, folder):
    value = F.col("value")
    return (
        read(spark, folder, "events")
        .select("event_id", F.explode(F.array(value, F.floor(value).cast("double"), value / 8)).alias("v"))
        .select("event_id", numbers.format_number(F.col("v")).alias("shown"))
    )


@query(
    "h24_geometric_mean",
    "SELECT user_id, round(exp(avg(ln(value))), 6) AS gmean FROM events WHERE value > 0 GROUP BY user_id",
)
def h24(spark, folder):
    return (
        read(spark, folder, "events")
        .where("value > 0")
        .groupBy("user_id")
        .agg(F.round(numbers.geometric_mean(F.col("value")), 6).alias("gmean"))
    )


@query(
    "h25_strip_tags",
    r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br />', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
    e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM s)
    SELECT page_id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS digest FROM e""",
)
def h25(spark, folder):
    return read(spark, folder, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("digest"))


@query(
    "h26_json_round_trip",
    """SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
      CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS top FROM events GROUP BY user_id""",
)
def h26(spark, folder):
    shape = "struct<k:bigint>"
    again = F.from_json(F.to_json(F.from_json("props", shape)), shape)
    return (
        read(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.sum(again["k"]).alias("total"), F.max(again["k"]).alias("top"))
    )
