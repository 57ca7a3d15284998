"""Text normalisation and tokenisation as column expressions.

A "word" character is a letter, a number or an underscore, in any script.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_TEXT = "EMPTY"
WORD = r"\p{L}\p{N}_"

# The ASCII punctuation characters removed before answers are compared.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Typographic quotes and dashes and the plain characters that replace them.
QUOTES_AND_DASHES = {
    "‘": "'",
    "’": "'",
    "´": "'",
    "`": "'",
    "“": '"',
    "”": '"',
    "‐": "-",
    "‑": "-",
    "‒": "-",
    "–": "-",
    "—": "-",
    "−": "-",
}


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one space and strip both ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """Split on whitespace; blank text has no words."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def normalize_for_match(c: Column) -> Column:
    return squeeze(F.lower(c))


def format_text(c: Column) -> Column:
    """Lower case, punctuation to spaces; unknown markers and blanks become EMPTY."""
    base = F.lower(F.trim(c))
    clean = squeeze(F.regexp_replace(base, rf"[^{WORD}]+|_", " "))
    return F.when(base.isin("n/a", "?") | (clean == ""), EMPTY_TEXT).otherwise(clean)


def format_and_tokenize(c: Column) -> Column:
    return words(format_text(c))


def tokenize(c: Column) -> Column:
    """Lower-case word runs and punctuation runs."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"([{WORD}]+|[^{WORD}\s]+)"), 1)


def normalize_answers(texts: Column) -> Column:
    """Comparable answer list: lower-cased, blanks of the kind null and NaN dropped, sorted."""
    kept = F.filter(texts, lambda t: t.isNotNull() & ~F.lower(F.trim(t)).rlike("^[+-]?nan$"))
    return F.sort_array(F.transform(kept, F.lower))


def normalize_qa_answer(c: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(c), PUNCTUATION, "")
    return squeeze(F.regexp_replace(plain, rf"(?<![{WORD}])(a|an|the)(?![{WORD}])", " "))


def strip_tags(c: Column) -> Column:
    """Drop markup, decode the common entities and squeeze whitespace."""
    text = F.regexp_replace(c, r"(?i)<br />", " ")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return squeeze(text)


def sentences(c: Column) -> Column:
    """Rule-based sentence split: after . ! or ? followed by whitespace."""
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def word_ngrams(tokens: Column, max_n: int, min_n: int = 1, sep: str = " ") -> Column:
    """All n-grams of a token array, for n between min_n and max_n."""
    size = F.size(tokens)

    def of_length(n: int) -> Column:
        starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), sep))

    parts = [of_length(n) for n in range(min_n, max_n + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def all_spans(c: Column, max_ngram_length: int) -> Column:
    """Character spans of every alphanumeric n-gram, as array<struct<begin,end>>.

    Words are found by splitting at every boundary between alphanumerics and the
    rest, so the lengths of the pieces give the offsets.
    """
    pieces = F.filter(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1), lambda p: p != "")
    empty = F.array().cast("array<struct<begin:int,end:int>>")
    walked = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(
                p.rlike(r"^[\p{L}\p{N}]"),
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("begin"), (acc["at"] + F.length(p)).alias("end")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    spans = walked["spans"]
    return F.flatten(
        F.transform(
            spans,
            lambda last, i: F.transform(
                F.slice(spans, F.greatest(i - (max_ngram_length - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(max_ngram_length))),
                lambda first: F.struct(first["begin"].alias("begin"), last["end"].alias("end")),
            ),
        )
    )


def quote_regex(needle: Column) -> Column:
    """Escape a literal for use inside a Java regular expression."""
    return F.regexp_replace(needle, r"([^\p{L}\p{N}\s])", r"\\$1")


def contains_tokens(haystack: Column, needle: Column) -> Column:
    """True when needle occurs in haystack on token boundaries."""
    pattern = F.concat(F.lit(r"(?U)(?:\b|\s)(?:"), quote_regex(needle), F.lit(r")(?:\s|\b)"))
    return F.regexp_like(haystack, pattern)


WORD_RUN = r"(?U)\w+"


def word_runs(c: Column) -> Column:
    """All runs of word characters in order."""
    return F.regexp_extract_all(c, F.lit(WORD_RUN), F.lit(0))


def between_runs(c: Column) -> Column:
    """What stands before, between and after the runs: one piece more than there are runs."""
    return F.split(c, WORD_RUN, -1)


def count_token_matches(haystack: Column, needle: Column) -> Column:
    pattern = F.concat(F.lit(r"(?U)(?:\b|\s)(?:"), quote_regex(needle), F.lit(r")(?:\s|\b)"))
    return F.regexp_count(haystack, pattern)


def jaccard(left: Column, right: Column, epsilon: float = 0.0) -> Column:
    """Overlap of two token sets by their union; epsilon keeps scores above zero."""
    both, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    score = (both + F.lit(epsilon)) / (either + F.lit(epsilon))
    return score if epsilon else F.when(either > 0, score).otherwise(0.0)


#: What may close an answer, read from its end: a bracketed note (the whole answer only if it is a
#: number), a row of marks, an aside after a space. A tail is any mix of them, with blanks between.
_NOTE, _MARKS, _ASIDE = r"\][^\]]*\[(?!\z)|\]\d++\[", "[•♦†‡*#+]++", r"\)[^)]*\( "
_TAIL = rf"(?U)\A(?:\s*+(?>{_NOTE}|{_MARKS}|{_ASIDE}))++\s*+"
_ENDS = r"(?U)\A\s+|\s+\z"


def _without_tail(c: Column) -> Column:
    """One scan from the right over all closing notes, marks and asides; c has no blanks at its ends."""
    return F.reverse(F.regexp_replace(F.reverse(c), _TAIL, ""))


def _decomposed(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without the marks that it sets free; nulls stay."""
    return texts.str.normalize("NFKD").str.replace(_ACCENTS, "", regex=True)


#: All code points of the category of non-spacing marks.
_ACCENTS = re.compile("[" + "".join(map(chr, (k for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k)) == "Mn"))) + "]+")


def fold_answer(c: Column) -> Column:
    """Strict answer normaliser: no diacritics, closing notes, asides or marks, nor quotes around all of it.

    Only texts beyond ASCII go through Python, for their decomposition. A quoted text holds no
    further quote, so its tail is cut once outside and once inside the quotes. One final stop
    goes, blanks are squeezed, the rest is in lower case without markup.
    """
    foreign = c.rlike(r"[^\x00-\x7F]")
    plain = F.coalesce(F.pandas_udf(_decomposed, "string")(F.when(foreign, c)), c)
    plain = F.translate(plain, "".join(QUOTES_AND_DASHES), "".join(QUOTES_AND_DASHES.values()))
    outside = _without_tail(F.regexp_replace(plain, _ENDS, ""))
    inside = F.regexp_replace(F.regexp_replace(outside, r'\A"([^"]*+)"\z', "$1"), _ENDS, "")
    bare = F.regexp_replace(_without_tail(inside), r"\.\z", "")
    single = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), r"\A | \z", "")
    return F.regexp_replace(F.lower(single), "<[^<]+?>", "")
