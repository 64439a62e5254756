"""Join shapes beyond plain equi-joins, each as an equi-join that Spark can distribute."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

WORDS_AT_ONCE = 100_000
SAMPLE = 0.02  # of the left rows, to tell common words
TOKENS_AT_ONCE = 500_000  # tokens of all right rows, each a word and an id, that every task may hold


def token_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: int, left_text: str = "text", right_text: str = "text") -> DataFrame:
    """(left_id, right_id, shared): pairs that share ``least`` distinct tokens or more; ids are those of one row each.

    Right rows of ``TOKENS_AT_ONCE`` tokens together, which are counted first, go to all tasks: left rows are read once
    and their pairs are counted where they are read, so that counts alone are shuffled. With more, pairs meet on rare tokens
    only, and their tokens are joined back and counted. Both ways give the same rows.
    """
    told = right.select(right_id, F.explode(T.overlap_tokens(F.col(right_text))).alias("token"))
    asked = left.select(left_id, F.explode(T.overlap_tokens(F.col(left_text))).alias("token"))
    if told.limit(TOKENS_AT_ONCE + 1).count() <= TOKENS_AT_ONCE:
        met = asked.join(F.broadcast(told), "token")
    else:
        often = left.sample(SAMPLE, seed=1).select(F.explode(T.overlap_tokens(F.col(left_text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        pairs = asked.join(_rare_tokens(told, often, right_id, least), "token").select(left_id, right_id).distinct()
        met = pairs.join(told, right_id).join(asked, [left_id, "token"])
    return met.groupBy(left_id, right_id).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def _rare_tokens(told: DataFrame, often: DataFrame, right_id: str, least: int) -> DataFrame:
    """(right_id, token): the tokens of a row but for the ``least - 1`` that ``often`` (token, n) counts most.

    A pair that shares ``least`` tokens shares one of these, whatever tokens are put aside; with the common ones aside,
    common words make no pairs.
    """
    order = Window.partitionBy(right_id).orderBy(F.desc_nulls_last("n"), F.length("token"), "token")
    ranked = told.join(often, "token", "left").select(right_id, "token", F.row_number().over(order).alias("k"))
    return ranked.where(F.col("k") >= least).select(right_id, "token")


def jaccard_pairs(rows: DataFrame, key: str, tokens: str, above: float, within: str | None = None) -> DataFrame:
    """(a, b, jaccard): pairs of rows, a < b by key, whose token sets have a similarity above a threshold; with ``within``, pairs of
    equal values of that column only.

    Such a pair shares more than ``above`` times the size of either set, so the first tokens of both sets, as many as may be
    missing and one more, have one in common, whatever the order. Long tokens come first, as they are the rarer ones, and
    no count of tokens is needed. Equal sizes bound the rest, and rows of a pair alone are compared whole. First tokens meet as
    64-bit hashes: one that two tokens share only adds a comparison.
    """
    sets = rows.select(key, F.col(tokens).alias("_t"), (F.col(within) if within else F.lit(0)).alias("_w"))
    # The shuffle is the one that both joins below need, so that tokens are made and moved once.
    sets = sets.where((F.size("_t") > 0) & F.col("_w").isNotNull()).repartition(*([key, "_w"] if within else [key]))
    first = F.sort_array(F.transform("_t", lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))
    size = F.size("_t")
    kept = size - F.floor(above * size).cast("int")  # more than floor(above * size) tokens are shared
    keys = sets.select(F.col(key).alias("_key"), "_w", size.alias("_n"), F.explode(F.slice(first, F.lit(1), kept)).alias("f"))
    keys = keys.select("_key", "_w", "_n", F.xxhash64("_w", "f.t").alias("token"))
    x, y = keys.alias("x"), keys.alias("y")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x._key") < F.col("y._key")) & F.expr("x._w <=> y._w")
    met = met & (F.least("x._n", "y._n") > above * F.greatest("x._n", "y._n"))
    pairs = x.join(y, met).select(F.col("x._key").alias("a"), F.col("y._key").alias("b"), "x._w").distinct()
    left, right = (sets.select(F.col(key).alias(n), F.col("_t").alias(f"_{n}"), "_w") for n in "ab")
    met_by = lambda n: [n, "_w"] if within else [n]
    if not within:
        pairs, left, right = pairs.drop("_w"), left.drop("_w"), right.drop("_w")
    found = pairs.join(left, met_by("a")).join(right, met_by("b")).select("a", "b", T.jaccard(F.col("_a"), F.col("_b")).alias("jaccard"))
    return found.where(F.col("jaccard") > above)


def near_anti(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float) -> DataFrame:
    """Rows of left with no value of right within the tolerance: an equi-join on bins of twice that width."""
    width = 2 * tolerance
    bins = right.select(F.col(right_value).cast("double").alias("_r")).where("_r IS NOT NULL").distinct()
    bins = bins.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("_r") / width) + k for k in (-1, 0, 1)])))
    rows = left.withColumn("_bin", F.floor(F.col(left_value).cast("double") / width)).alias("l")
    close = (F.col("l._bin") == F.col("b._bin")) & (F.abs(F.col(f"l.{left_value}") - F.col("b._r")) <= tolerance)
    return rows.join(bins.alias("b"), close, "left_anti").drop("_bin")


def lookup_with_fallback(rows: DataFrame, parents: DataFrame, key: str, fallback: str, value: str) -> DataFrame:
    """The parent's value by key, else by the fallback key (smallest value of equal fallback keys)."""
    by_key = parents.select(key, F.col(value).alias("_by_key"))
    by_other = parents.groupBy(fallback).agg(F.min(value).alias("_by_other"))
    out = rows.join(by_key, key, "left").join(by_other, fallback, "left")
    return out.withColumn(value, F.coalesce("_by_key", "_by_other")).drop("_by_key", "_by_other")


def linked_lists(rows: DataFrame, links: DataFrame, details: DataFrame, key: str, link: str, item: Column, order: list[str]) -> DataFrame:
    """Bridge join: every row with the ordered list of its linked details (empty where there are none)."""
    met = links.join(details, link).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("item")))).alias("_items"))
    out = rows.join(met, key, "left").withColumn("items", F.transform(F.coalesce("_items", F.array()), lambda x: x["item"]))
    return out.drop("_items")


def known_edges(edges: DataFrame, nodes: DataFrame, source: str = "src", target: str = "dst", node: str = "node_id") -> DataFrame:
    """Edges whose both ends are nodes."""
    ids = nodes.select(node).distinct()
    kept = edges.join(ids.withColumnRenamed(node, source), source, "left_semi")
    return kept.join(ids.withColumnRenamed(node, target), target, "left_semi").select(*edges.columns)


def undirected_once(edges: DataFrame, source: str = "src", target: str = "dst", order: str = "seq") -> DataFrame:
    """(a, b) and (b, a) are one edge; the first stays as it stands."""
    from .ordering import first_per_key

    keyed = edges.withColumns({"_a": F.least(source, target), "_b": F.greatest(source, target)})
    return first_per_key(keyed, ["_a", "_b"], [F.col(order)]).drop("_a", "_b")


def fuzzy_lookup(lines: DataFrame, lexicon: DataFrame, text: str = "text", word: str = "word", most: int = 2) -> DataFrame:
    """Adds ``corrected``: the lexicon word equal to the line, else the longest contained in it, else the nearest by edits.

    Different lines are looked up once each, and joined back by their text. The lexicon is sent to the tasks in blocks of
    ``WORDS_AT_ONCE`` words, whatever its size. Ties go to the shorter, then the alphabetically first word.
    """
    words = lexicon.select(F.col(word).alias("_word")).where("_word IS NOT NULL").distinct()
    blocks = words.count() // WORDS_AT_ONCE + 1
    keyed = lines.select(F.col(text).alias("_line")).where("_line IS NOT NULL").distinct()
    compact = lambda c: F.lower(F.regexp_replace(c, "[^0-9a-zA-Z가-힣]", ""))
    a, b = compact(F.col("_line")), compact(F.col("_word"))
    distance = F.levenshtein(a, b, most)
    kind = F.when(a == b, 0).when((F.length(b) >= 2) & a.contains(b), 1).when(distance >= 0, 2)
    parts = [words.where(F.pmod(F.xxhash64("_word"), F.lit(blocks)) == k) if blocks > 1 else words for k in range(blocks)]
    met = reduce(DataFrame.unionByName, (keyed.join(F.broadcast(part), (a != "") & kind.isNotNull()) for part in parts)).withColumn("_kind", kind)
    size = F.when(F.col("_kind") == 1, -F.length("_word")).otherwise(F.when(F.col("_kind") == 2, distance).otherwise(0))
    best = met.groupBy("_line").agg(F.min(F.struct("_kind", size.alias("s"), F.length("_word").alias("l"), "_word"))["_word"].alias("corrected"))
    return lines.join(best, F.col(text) == F.col("_line"), "left").withColumn("corrected", F.coalesce("corrected", text)).drop("_line")


def smallest_container(points: DataFrame, rects: DataFrame, page_area: Column, low: float = 0.04, high: float = 0.85) -> DataFrame:
    """Each point (page, node_id, cx, cy) with the smallest rectangle (page, rect_id, x0, y0, x1, y1) around it."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    fit = rects.withColumn("area", area).where((F.col("area") >= low * page_area) & (F.col("area") <= high * page_area))
    inside = F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1"))
    met = points.join(fit, "page").where(inside)
    best = met.groupBy("page", "node_id").agg(F.min(F.struct("area", "rect_id"))["rect_id"].alias("rect_id"))
    return points.join(best, ["page", "node_id"], "left")


def nearest_node(points: DataFrame, nodes: DataFrame, tolerance: Column) -> DataFrame:
    """Each point (page, point_id, px, py) with the nearest node (page, idx, node_id, x0, y0, x1, y1) in reach.

    The distance is the smaller of that to the box and 0.85 times that to its centre; of equal ones the later node wins.
    """
    dx = F.greatest(F.col("x0") - F.col("px"), F.lit(0.0), F.col("px") - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col("py"), F.lit(0.0), F.col("py") - F.col("y1"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2 - F.col("px"), (F.col("y0") + F.col("y1")) / 2 - F.col("py")
    d = F.least(F.sqrt(dx * dx + dy * dy), 0.85 * F.sqrt(cx * cx + cy * cy))
    met = points.join(nodes, "page").withColumn("d", d).where(F.col("d") <= tolerance)
    best = met.groupBy("page", "point_id").agg(F.min(F.struct("d", (-F.col("idx")).alias("later"), "node_id"))["node_id"].alias("node_id"))
    return points.join(best, ["page", "point_id"], "left")
