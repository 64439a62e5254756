"""Structure graphs of diagram pages as node, edge and group rows, by spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins
from .layout import PAGE, clusters
from .ordering import first_per_key

#: Labels that are never nodes; a table, so that a domain can bring its own.
SKIP_LABELS = ("contents",)


def nodes(blocks: DataFrame, skip: tuple[str, ...] = SKIP_LABELS) -> DataFrame:
    """(page, idx, node_id, label, x0, y0, x1, y1, width, height) from blocks with width and height of their page.

    The first line of a block is its label, repeats joined by `` · `` are labels of their own; the first of each label
    (without case and white space) stays.
    """
    usable = blocks.where(~F.col("block_type").isin("IMAGE", "STRUCTURE") & (F.trim("text") != "") & (F.col("text") != "[IMAGE]"))
    usable = usable.where(~(F.col("text").contains("|") & (F.length("text") > 40)))
    line = F.regexp_replace(F.get(F.split(F.trim("text"), "\n"), F.lit(0)), r"^§\s*", "")
    rows = usable.select("*", F.posexplode(F.split(line, " · ", -1)).alias("part", "_raw")).withColumn("label", F.trim("_raw"))
    rows = rows.withColumn("key", F.lower(F.regexp_replace("label", r"\s+", "")))
    title = (F.col("x1") - F.col("x0") > F.col("width") * 0.55) & (F.col("y0") < F.col("height") * 0.2)
    fine = F.length("label").between(1, 36) & ~F.lower("label").isin(*skip) & ~F.col("label").contains("|") & ~F.col("label").rlike(r"^\d{4}$") & (F.length("key") >= 2)
    once = first_per_key(rows.where(fine & ~title), [*PAGE, "key"], [F.col("seq"), F.col("part")])
    w = Window.partitionBy(*PAGE).orderBy("seq", "part")
    out = once.withColumn("idx", F.row_number().over(w) - 1)
    return out.select(*PAGE, "idx", F.concat(F.lit("N"), "idx").alias("node_id"), "label", "x0", "y0", "x1", "y1", "width", "height")


# How sure an edge is, and the longest label that names a medium.
LINE_CONFIDENCE, COLUMN_CONFIDENCE, MEDIUM_CHARS = 0.82, 0.62, 12
LEAST_LINE, LEAST_RECT, LEAST_SHAPE = 8, 40, 200  # points; square points


def primitives(pages: DataFrame) -> DataFrame:
    """Lines and rectangles (source_id, page, seq, kind, x0, y0, x1, y1, px0, py0, px1, py1) of pages (source_id, page, paths).

    A path has a rectangle around it and items: ``l`` from a point to a point, ``re`` with two corners, ``c`` with four points,
    of which the ends make a line. Lines of width and height of under 8 together (curves aside) and rectangles of an area of
    under 40 are left out. A path without ``re`` is itself a rectangle if its area is 200 or more. seq follows the drawing
    order, a path's own rectangle after its items; p0 and p1 are the ends of a line as they were drawn.
    """
    paths = pages.select(*PAGE, F.posexplode("paths").alias("path_no", "path"))
    point = lambda k: F.get("item.points", F.lit(k))
    last = F.when(F.col("item.op") == "c", point(3)).otherwise(point(1))
    items = paths.select(*PAGE, "path_no", F.posexplode("path.items").alias("item_no", "item")).where(F.col("item.op").isin("l", "re", "c"))
    items = items.select(*PAGE, "path_no", "item_no", F.col("item.op").alias("op"), point(0).alias("p"), last.alias("q")).where("p IS NOT NULL AND q IS NOT NULL")
    low, high = (lambda axis: F.least(f"p.{axis}", f"q.{axis}")), (lambda axis: F.greatest(f"p.{axis}", f"q.{axis}"))
    whole = F.col("op") == "re"
    items = items.select(
        *PAGE, "path_no", "item_no", "op", F.when(whole, "rect").otherwise("line").alias("kind"),
        F.when(whole, F.col("p.x")).otherwise(low("x")).alias("x0"), F.when(whole, F.col("p.y")).otherwise(low("y")).alias("y0"),
        F.when(whole, F.col("q.x")).otherwise(high("x")).alias("x1"), F.when(whole, F.col("q.y")).otherwise(high("y")).alias("y1"),
        *(F.when(~whole, F.col(c)).alias(f"p{n}") for c, n in (("p.x", "x0"), ("p.y", "y0"), ("q.x", "x1"), ("q.y", "y1"))),
    )
    wide, high_ = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fit = F.when(F.col("op") == "l", wide + high_ >= LEAST_LINE).when(F.col("op") == "re", wide * high_ >= LEAST_RECT).otherwise(F.lit(True))
    shapes = paths.where(~F.exists(F.coalesce("path.items", F.array().cast("array<struct<op:string,points:array<struct<x:double,y:double>>>>")), lambda i: i["op"] == "re"))
    nothing = F.lit(None).cast("double")
    shapes = shapes.select(
        *PAGE, "path_no", F.lit(2**31 - 1).alias("item_no"), F.lit("path").alias("op"), F.lit("rect").alias("kind"), "path.x0", "path.y0", "path.x1", "path.y1",
        *(nothing.alias(n) for n in ("px0", "py0", "px1", "py1")),
    ).where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= LEAST_SHAPE)
    every = items.where(fit).unionByName(shapes)
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("path_no", "item_no")) - 1
    return every.select(*PAGE, number.alias("seq"), "kind", "x0", "y0", "x1", "y1", "px0", "py0", "px1", "py1")


def _on_page(df: DataFrame) -> DataFrame:
    """The joins take one page key."""
    return df.withColumn("page", F.struct(*PAGE)).drop("source_id")


def line_edges(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Edges (page, seq, src, dst, label, medium, confidence) between the nodes nearest to the ends of lines (page, seq, px0, py0, px1, py1)."""
    tolerance = F.greatest(F.lit(28.0), F.col("width") * 0.035)
    spots = F.array(
        F.struct(F.lit(0).alias("end"), F.col("px0").alias("px"), F.col("py0").alias("py"), F.lit(1.0).alias("reach")),
        F.struct(F.lit(1).alias("end"), F.col("px1").alias("px"), F.col("py1").alias("py"), F.lit(1.0).alias("reach")),
        F.struct(F.lit(2).alias("end"), ((F.col("px0") + F.col("px1")) / 2).alias("px"), ((F.col("py0") + F.col("py1")) / 2).alias("py"), F.lit(0.8).alias("reach")),
    )
    points = _on_page(lines).select("page", "seq", F.explode(spots).alias("s")).select("page", F.struct("seq", "s.end").alias("point_id"), "s.px", "s.py", "s.reach")
    near = joins.nearest_node(points, _on_page(found), tolerance * F.col("reach"))

    def at(end: int) -> Column:
        return F.max(F.when(F.col("point_id.end") == end, F.col("node_id")))

    ends = near.groupBy("page", F.col("point_id.seq").alias("seq")).agg(at(0).alias("src"), at(1).alias("dst"), at(2).alias("mid"))
    ends = ends.where("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    names = _on_page(found).select("page", F.col("node_id").alias("mid"), "label")
    out = ends.join(names, ["page", "mid"], "left").withColumn("label", F.when(~F.col("mid").isin(F.col("src"), F.col("dst")), F.col("label")))
    medium = F.when(F.length("label") <= MEDIUM_CHARS, F.col("label"))
    return joins_first(out.select("page.source_id", "page.page", "seq", "src", "dst", "label", medium.alias("medium"), F.lit(LINE_CONFIDENCE).alias("confidence")))


def column_edges(found: DataFrame) -> DataFrame:
    """Edges between neighbours of a column that are stacked closely."""
    nothing = F.lit(None).cast("string")
    columned = clusters(found.withColumns({"seq": F.col("idx"), "block_type": F.lit("TEXT"), "text": F.col("label")}), "x")
    w = Window.partitionBy(*PAGE, "cluster").orderBy((F.col("y0") + F.col("y1")) / 2, "idx")
    pairs = columned.withColumns({"dst": F.lead("node_id").over(w), "gap": F.lead("y0").over(w) - F.col("y1")})
    pairs = pairs.where(F.col("dst").isNotNull() & (F.col("gap") <= F.col("width") * 0.15))
    return pairs.select(*PAGE, (F.lit(1_000_000) + F.col("cluster") * 1000 + F.col("idx")).alias("seq"), F.col("node_id").alias("src"), "dst", nothing.alias("label"), nothing.alias("medium"), F.lit(COLUMN_CONFIDENCE).alias("confidence"))


def joins_first(edges: DataFrame) -> DataFrame:
    """(a, b) and (b, a) of a page are one edge; the first stays."""
    keyed = edges.withColumns({"_a": F.least("src", "dst"), "_b": F.greatest("src", "dst")})
    return first_per_key(keyed, [*PAGE, "_a", "_b"], [F.col("seq")]).drop("_a", "_b").select("source_id", "page", "seq", "src", "dst", "label", "medium", "confidence")


def groups(found: DataFrame, rects: DataFrame) -> DataFrame:
    """(page, node_id, group): the smallest fitting rectangle around a node's centre, named by its topmost label."""
    points = _on_page(found).withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    boxes = _on_page(rects.withColumn("rect_id", F.col("seq"))).select("page", "rect_id", "x0", "y0", "x1", "y1")
    size = points.select("page", (F.col("width") * F.col("height")).alias("page_area")).distinct()
    inside = joins.smallest_container(points.select("page", "node_id", "label", "cx", "cy"), boxes.join(size, "page"), F.col("page_area")).where("rect_id IS NOT NULL")
    named = inside.join(boxes, ["page", "rect_id"])
    top = F.col("cy") <= F.col("y0") + F.greatest(F.lit(40.0), (F.col("y1") - F.col("y0")) * 0.25)
    label = named.groupBy("page", "rect_id").agg(F.min_by(F.when(top, F.substring("label", 1, 24)), F.when(top, F.struct("cy", "label"))).alias("g"))
    label = label.withColumn("group", F.coalesce("g", F.concat(F.lit("구역"), F.col("rect_id").cast("string"))))
    return inside.join(label, ["page", "rect_id"]).select("page.source_id", "page.page", "node_id", "group")


BAND_NODES, BAND_NAME = 4, 20  # nodes of a page that has bands, and the longest label that names one


def band_groups(found: DataFrame) -> DataFrame:
    """(page, node_id, group): columns of two nodes or more, on pages of four nodes and two columns or more, named by the topmost
    label or, where that is long, by their number from the left."""
    columned = clusters(found.withColumns({"seq": F.col("idx"), "block_type": F.lit("TEXT"), "text": F.col("label")}), "x")
    bands = columned.groupBy(*PAGE, "cluster").agg(F.count("*").alias("k"), F.min_by("label", F.struct("y0", "idx")).alias("head"))
    pages = bands.groupBy(*PAGE).agg(F.count("*").alias("bands"), F.sum("k").alias("n")).where((F.col("bands") >= 2) & (F.col("n") >= BAND_NODES))
    name = F.when(F.length("head") <= BAND_NAME, F.col("head")).otherwise(F.concat(F.lit("열"), (F.col("cluster") + 1).cast("string")))
    named = bands.where("k >= 2").join(pages.select(*PAGE), PAGE, "left_semi").select(*PAGE, "cluster", name.alias("group"))
    return columned.join(named, [*PAGE, "cluster"]).select(*PAGE, "node_id", "group")


def grouped_nodes(found: DataFrame, rects: DataFrame) -> DataFrame:
    """(page, node_id, group) by rectangles; by columns on pages where no rectangle holds a node."""
    boxed = groups(found, rects)
    rest = found.join(boxed.select(*PAGE).distinct(), PAGE, "left_anti")
    return boxed.unionByName(band_groups(rest))


def graph_facts(found: DataFrame, lines: DataFrame, rects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, edges): per page kind, confidence and status of its graph; pages with under two nodes have none."""
    by_line = line_edges(found, lines)
    counts = by_line.groupBy(*PAGE).agg(F.count("*").alias("n_line"))
    lined = counts.where("n_line >= 2").select(*PAGE)
    edges = joins_first(by_line.unionByName(column_edges(found).join(lined, PAGE, "left_anti")))
    grouped = grouped_nodes(found, rects).groupBy(*PAGE).agg(F.sort_array(F.collect_set("group")).alias("groups"))
    boxes = rects.groupBy(*PAGE).agg(F.count("*").alias("n_rects"))
    facts = found.groupBy(*PAGE).agg(F.count("*").alias("n_nodes"), F.avg(F.length("label")).alias("avg_label")).where("n_nodes >= 2")
    facts = facts.join(counts, PAGE, "left").join(edges.groupBy(*PAGE).agg(F.count("*").alias("n_edges")), PAGE, "left")
    facts = facts.join(grouped, PAGE, "left").join(boxes, PAGE, "left").na.fill(0, ["n_line", "n_edges", "n_rects"])
    facts = facts.withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))
    n_groups = F.size("groups")
    kind = (
        F.when((F.col("n_line") < 2) & (F.col("n_edges") >= 3) & (n_groups == 0), "PROCESS").when((n_groups >= 2) & (F.col("n_rects") >= 2), "ARCHITECTURE")
        .when((F.col("avg_label") <= 14) & (F.col("n_nodes") >= 6) & (F.col("n_line") >= 3), "PROCESS").when(n_groups >= 2, "ARCHITECTURE")
        .when(F.col("n_nodes") >= 8, "PROCESS").otherwise("ARCHITECTURE")
    )
    facts = facts.withColumn("kind", kind)
    confidence = F.greatest(
        F.lit(0.55), F.when((F.col("n_line") > 0) & (F.col("n_edges") > 0), 0.78), F.when((n_groups > 0) & (F.col("kind") == "ARCHITECTURE"), 0.72),
        F.when((F.col("n_edges") > 0) & (F.col("kind") == "PROCESS"), 0.7),
    )
    facts = facts.withColumn("confidence", confidence)
    status = F.when((F.col("confidence") >= 0.75) & (F.col("n_edges") > 0), "VERIFIED").otherwise("REQUIRES_VISUAL_CHECK")
    return facts.withColumn("status", status).drop("avg_label", "n_line", "n_rects"), edges
