"""Text expressions: Column to Column, no Python in the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns and words.
OVERLAP_TOKEN = "[a-z0-9]+|[가-힣]{2,}"
TERM_TOKEN = r"[A-Za-z][A-Za-z0-9\-_/]+|[가-힣]{2,}"
SEARCH_TOKEN = r"[\p{L}\p{N}]+"
STOP_WORDS = (
    "그리고", "또는", "위한", "대한", "있는", "없는", "통해", "관련", "기반", "기존", "구축", "페이지", "소개", "개요", "the", "and", "for", "with",
)
STRONG_WORDS = ("증가", "감소", "향상", "입증", "보장", "반드시", "완벽하게", "원인이다")
PROMOTIONAL = ("최고의", "혁신적인 솔루션", "완벽한", "업계 최고", "반드시 도입", "세계 최고")
CITATION = r"\[([A-Za-z0-9\-]+),\s*p\.(\d+)\]"
VECTOR_DIMS = 256
BIGRAMS = 200


def overlap_tokens(text: Column) -> Column:
    """Distinct lower-case tokens for overlap and Jaccard scores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(OVERLAP_TOKEN), F.lit(0)))


def search_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits in order, as the keyword index sees them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(SEARCH_TOKEN), F.lit(0))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM_TOKEN), F.lit(0))


def is_stop_word(term: Column) -> Column:
    return F.lower(term).isin(*STOP_WORDS)


def embedding_head(text: Column) -> Column:
    """What the character bigrams are taken from: the first 201 characters that are no white space."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""), 1, BIGRAMS + 1)


def embedding_tokens(text: Column, head: Column) -> Column:
    """Lower-case word tokens, then the character bigrams (case kept) of a head, a column made with embedding_head."""
    pairs = F.when(
        F.length(head) > 1, F.transform(F.sequence(F.lit(1), F.length(head) - 1), lambda i: F.substring(head, i, F.lit(2)))
    ).otherwise(F.array().cast("array<string>"))
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(OVERLAP_TOKEN), F.lit(0))
    return F.concat(words, pairs)


def token_code(token: Column) -> Column:
    """The last twelve bits of a token's md5, from which its dimension and sign come."""
    return F.conv(F.substring(F.md5(token), 30, 3), 16, 10).cast("int")


def code_dimension(code: Column) -> Column:
    """Dimension of a token: its md5 modulo 256."""
    return code.bitwiseAND(F.lit(VECTOR_DIMS - 1))


def code_sign(code: Column) -> Column:
    """+1 or -1: bit 8 of the token's md5."""
    return F.when(code.bitwiseAND(F.lit(VECTOR_DIMS)) != 0, 1).otherwise(-1)


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles; 0 where lengths differ or a side is null or empty."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis where something is cut."""
    flat = collapse_space(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def compact_key(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, r"(?U)\s", ""))


def letters_key(text: Column) -> Column:
    """Lower case; keeps 0-9, a-z, Hangul syllables and %+-."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z가-힣%+\\-]", "")


def citations(text: Column) -> Column:
    """array<struct<source_id, page>> of ``[SID, p.N]`` marks in order."""
    sources = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    pages = F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(2)), lambda p: p.cast("int"))
    return F.arrays_zip(sources.alias("source_id"), pages.alias("page"))


def citation(source_id: Column, page: Column) -> Column:
    return F.format_string("[%s, p.%d]", source_id, page)


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*" + CITATION, "")


def percents(text: Column) -> Column:
    """array<double> of numbers before a percent sign, distinct."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("double")))


def number(text: Column) -> Column:
    """A number with thousands commas."""
    return F.translate(text, ",", "").try_cast("double")


def paragraphs(markdown: Column) -> Column:
    """Paragraphs without headings and section marks; paragraph marks are cut."""
    parts = F.transform(F.split(markdown, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    parts = F.filter(parts, lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("<!-- SECTION"))
    parts = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"<!--\s*P-[^>]+-->", ""), r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def is_major_claim(text: Column) -> Column:
    return text.rlike(r"\d|" + "|".join(STRONG_WORDS))


def promotional_phrases(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, PROMOTIONAL)), lambda p: text.contains(p))


def first_match(text: Column, cases: list[tuple[str, tuple[str, ...]]], otherwise: Column) -> Column:
    """Ordered keyword CASE: the label of the first case with a keyword in the lower-cased text."""
    low = F.lower(text)
    chain = None
    for label, words in cases:
        hit = reduce(Column.__or__, (low.contains(w.lower()) for w in words))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(otherwise)


def looks_like_table(text: Column) -> Column:
    """Two of three lines or more have two bars or two tabs."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line) != "")

    def count(line: Column, mark: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))

    bars = F.filter(lines, lambda line: (count(line, "|") >= 2) | (count(line, "\t") >= 2))
    return (F.size(lines) >= 3) & (F.size(bars) >= 2)


def looks_like_chart(text: Column) -> Column:
    """Two chart words or more, and a digit."""
    low = F.lower(text)
    marks = ("%", "증가", "감소", "향상", "baseline", "before", "after", "vs")
    hits = reduce(Column.__add__, (low.contains(m).cast("int") for m in marks))
    return (hits >= 2) & text.rlike("[0-9]")
