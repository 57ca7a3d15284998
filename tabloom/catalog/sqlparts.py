"""SQL fragments shared by the checking queries (DuckDB dialect)."""

# Orders as tables: ot_rows (wide), ot_body (cells without header), ot_cells, ot_tables.
OT = """
ot_rows AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS table_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS row,
    CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS c0,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS c1,
    CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS c2,
    CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS c3,
    l_returnflag AS c4, l_linestatus AS c5, strftime(l_shipdate, '%Y-%m-%d') AS c6
  FROM lineitem),
ot_body AS (
  SELECT table_id, row, CAST(unnest([0,1,2,3,4,5,6]) AS INTEGER) AS col, unnest([c0,c1,c2,c3,c4,c5,c6]) AS text
  FROM ot_rows),
ot_cells AS (
  SELECT table_id, row, col, text FROM ot_body
  UNION ALL
  SELECT table_id, -1, CAST(unnest([0,1,2,3,4,5,6]) AS INTEGER),
    unnest(['l_quantity','l_extendedprice','l_discount','l_tax','l_returnflag','l_linestatus','l_shipdate'])
  FROM ot_rows WHERE row = 0),
ot_tables AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS table_id, CAST(o_custkey AS VARCHAR) AS document_title,
    'http://tables.example/w?title=' || o_custkey || '&amp;oldid=' || strftime(o_orderdate, '%Y%m%d') AS document_url,
    CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS version, n_rows, 7 AS n_cols
  FROM orders JOIN (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_rows FROM lineitem GROUP BY l_orderkey)
    ON l_orderkey = o_orderkey)
"""

WITH_OT = "WITH " + OT


def sha_limbs(text: str, digits: int = 16) -> str:
    """Sum of the limbs of sha-256 of a text expression."""
    kind = "UBIGINT" if digits == 16 else "BIGINT"
    limbs = [f"CAST(CAST('0x' || substr(sha256({text}), {s}, {digits}) AS {kind}) AS HUGEINT)" for s in range(1, 65, digits)]
    return "(" + " + ".join(limbs) + ")"


def fp64(text: str) -> str:
    return f"({sha_limbs(text)} % 18446744073709551615)"


def uniform(text: str) -> str:
    return f"(CAST({fp64(text)} AS DOUBLE) / 18446744073709551615.0::DOUBLE)"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def format_text(text: str) -> str:
    clean = squeeze(f"regexp_replace(lower(trim({text})), '[^\\p{{L}}\\p{{N}}_]+|_', ' ', 'g')")
    return f"CASE WHEN lower(trim({text})) IN ('n/a','?') OR {clean} = '' THEN 'EMPTY' ELSE {clean} END"


def tokens(text: str) -> str:
    return f"string_split({format_text(text)}, ' ')"


def qa_answer(text: str) -> str:
    """Article removal twice, because RE2 has no look-around and neighbours share a space."""
    plain = f"""translate(lower({text}), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"""
    padded = f"(' ' || regexp_replace({plain}, '\\s+', ' ', 'g') || ' ')"
    once = f"regexp_replace({padded}, '([^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g')"
    twice = f"regexp_replace({once}, '([^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g')"
    return squeeze(twice)
