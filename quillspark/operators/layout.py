"""Page layout from block geometry: clusters, reading order, key-value rows, section marks and page types.

Blocks are rows (source_id, page, seq, block_type, text, x0, y0, x1, y1, confidence, width), where width is that of the
page. A page's blocks are few; everything is grouped by page and pages spread over the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import running_mean_clusters, upper_median

PAGE = ["source_id", "page"]
TEXTISH = ("TEXT", "OCR", "TABLE", "STRUCTURE")
_QUANTITY = r"(?i)^\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:%|퍼센트|명|원|천원|만원|억원|조원|달러|건|개|회|대|톤|kg|t|ton)$"


def _centre(axis: str) -> Column:
    return (F.col(f"{axis}0") + F.col(f"{axis}1")) / 2


def _filled(types: tuple[str, ...] = TEXTISH) -> Column:
    return F.col("block_type").isin(*types) & (F.trim(F.coalesce("text", F.lit(""))) != "")


def clusters(blocks: DataFrame, axis: str) -> DataFrame:
    """Adds ``cluster``: columns for axis x, rows for axis y. Tolerances follow the upper median block size."""
    other = "y" if axis == "x" else "x"
    floor, least, share = (12.0, 28.0, 0.9) if axis == "x" else (8.0, 10.0, 0.6)
    size = F.greatest(F.lit(floor), F.col(f"{axis}1") - F.col(f"{axis}0"))
    item = F.struct(_centre(axis).alias("c"), F.col(f"{other}0").alias("o"), "seq")
    pages = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("items"), upper_median(F.collect_list(size)).alias("m"), F.first("width").alias("w"))
    tolerance = F.greatest(F.lit(least), F.col("m") * share)
    if axis == "x":
        tolerance = F.least(tolerance, F.col("w") * 0.12)
    pages = pages.withColumn("tolerance", tolerance)
    ids = running_mean_clusters(F.transform("items", lambda i: i["c"]), F.col("tolerance"))
    pairs = pages.withColumn("ids", ids).select(*PAGE, F.explode(F.arrays_zip("items", "ids")).alias("z"))
    return blocks.join(pairs.select(*PAGE, F.col("z.items.seq").alias("seq"), F.col("z.ids").alias("cluster")), [*PAGE, "seq"])


def multi_column_pages(columned: DataFrame) -> DataFrame:
    """Pages of parallel narrow columns: six blocks or more, few tables, narrow, two columns beside each other."""
    width = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"))
    pages = columned.groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.count_if(F.col("block_type") == "TABLE").alias("tables"), (F.avg(width) / F.first("width")).alias("share")
    )
    spans = columned.groupBy(*PAGE, "cluster").agg(F.count("*").alias("k"), F.min("y0").alias("a"), F.max("y1").alias("b")).where("k >= 2")
    left, right = spans.alias("l"), spans.alias("r")
    beside = (F.col("l.source_id") == F.col("r.source_id")) & (F.col("l.page") == F.col("r.page")) & (F.col("l.cluster") < F.col("r.cluster"))
    both = F.least("l.b", "r.b") - F.greatest("l.a", "r.a")
    either = F.greatest("l.b", "r.b") - F.least("l.a", "r.a")
    parallel = left.join(right, beside & (either > 0) & (both / either >= 0.35)).select("l.source_id", "l.page").distinct()
    return pages.where("n >= 6 AND tables < 2 AND share <= 0.28").select(*PAGE).join(parallel, PAGE, "left_semi")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds ``reading_order`` from 0: by column where a page has parallel columns, else by row; other blocks come last."""
    said = blocks.where(_filled())
    columns = clusters(said, "x")
    multi = multi_column_pages(columns).withColumn("multi", F.lit(True))
    by_column = columns.select(*PAGE, "seq", F.col("cluster").alias("col"))
    by_row = clusters(said, "y").select(*PAGE, "seq", F.col("cluster").alias("row"))
    keyed = blocks.join(by_column, [*PAGE, "seq"], "left").join(by_row, [*PAGE, "seq"], "left").join(multi, PAGE, "left")
    first = F.when(F.col("col").isNull(), F.lit(1_000_000)).when(F.col("multi"), F.col("col")).otherwise(F.col("row"))
    second = F.when(F.col("col").isNull(), F.col("seq").cast("double")).when(F.col("multi"), _centre("y")).otherwise(F.col("x0"))
    w = Window.partitionBy(*PAGE).orderBy(first, second, "x0", "seq")
    return keyed.withColumn("reading_order", F.row_number().over(w) - 1).drop("col", "row", "multi")


def promote_key_values(blocks: DataFrame) -> DataFrame:
    """Multi-line blocks: header pairs and label-with-body become ``a | b`` tables, stacked quantities stay, repeats join."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.withColumn("_l", F.when(_filled(("TEXT", "OCR")), lines).otherwise(F.array().cast("array<string>")))
    n, head = F.size("_l"), F.get("_l", F.lit(0))
    body = F.array_join(F.slice("_l", 2, F.greatest(n, F.lit(1))), " ")
    second = F.get("_l", F.lit(1))
    sizes = F.transform("_l", lambda x: F.length(x))
    same = F.size(F.array_distinct(F.transform("_l", lambda x: T.compact_key(x)))) == 1
    marked = F.forall("_l", lambda x: x.startswith("[") & x.endswith("]"))
    years = F.forall("_l", lambda x: x.rlike(r"^\d{4}$"))
    pair = (n == 2) & (F.length(head) <= 16) & (F.length(second) <= 16)
    stacked = pair & head.rlike(_QUANTITY) & second.rlike(_QUANTITY)
    repeats = (n >= 2) & (F.array_max(sizes) <= 16) & (F.array_max(sizes) - F.array_min(sizes) <= 6) & (same | marked | years)
    keyed = (n >= 2) & (F.length(head) <= 24) & (F.length(body) >= F.greatest(F.lit(18), 2 * F.length(head))) & ~F.col("text").contains("|") & ~head.rlike("[.,;]$")
    text = (
        F.when(stacked, F.array_join("_l", "\n")).when(pair, F.concat_ws(" | ", head, second)).when(repeats, F.array_join("_l", " · "))
        .when(keyed, F.concat_ws(" | ", head, body)).otherwise(F.col("text"))
    )
    table = (pair & ~stacked) | (keyed & ~pair & ~repeats)
    out = rows.withColumns({"_t": text, "_table": F.coalesce(table, F.lit(False))})
    return out.withColumns(
        {
            "text": F.col("_t"), "block_type": F.when(F.col("_table"), "TABLE").otherwise(F.col("block_type")),
            "confidence": F.when(F.col("_table"), F.least(F.lit(0.9), F.col("confidence"))).otherwise(F.col("confidence")),
        }
    ).drop("_l", "_t", "_table")


def column_splits(blocks: DataFrame) -> DataFrame:
    """(page, split_x): middle of the widest gap between block centres in the left three quarters of a page."""
    w = Window.partitionBy(*PAGE).orderBy("c", "seq")
    gaps = blocks.withColumn("c", _centre("x")).withColumn("next", F.lead("c").over(w))
    gaps = gaps.withColumns({"gap": F.col("next") - F.col("c"), "mid": (F.col("next") + F.col("c")) / 2})
    gaps = gaps.where(F.col("mid").between(F.col("width") * 0.05, F.col("width") * 0.75))
    best = gaps.groupBy(*PAGE).agg(F.max(F.struct("gap", (-F.col("mid")).alias("left"), "width")).alias("b"))
    return best.where(F.col("b.gap") >= F.greatest(F.lit(30.0), F.col("b.width") * 0.06)).select(*PAGE, (-F.col("b.left")).alias("split_x"))


def pair_rows(blocks: DataFrame) -> DataFrame:
    """Cells left and right of the widest gap in one row become one ``left | right`` TABLE row in their place."""
    cells = blocks.where(_filled(("TEXT", "OCR")))
    enough = cells.groupBy(*PAGE).agg(F.count("*").alias("n")).where("n >= 4").select(*PAGE)
    cells = clusters(cells.join(enough, PAGE, "left_semi"), "y").join(column_splits(cells), PAGE).withColumn("side", (_centre("x") >= F.col("split_x")).cast("int"))

    def joined(side: int) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("x0", "seq", F.trim("text").alias("t")))))
        return F.array_join(F.transform(items, lambda i: i["t"]), " ")

    rows = cells.groupBy(*PAGE, "cluster").agg(
        joined(0).alias("l"), joined(1).alias("r"), F.min("seq").alias("seq"), F.collect_list("seq").alias("used"), F.min("x0").alias("x0"),
        F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("width").alias("width"),
    )
    good = (F.col("l") != "") & (F.col("r") != "") & ~F.col("l").contains("|") & ~F.col("r").contains("|")
    rows = rows.where(good & (F.length("l") <= F.length("r")) & (F.length("l") <= 40))
    used = rows.select(*PAGE, F.explode("used").alias("seq"))
    made = rows.select(
        *PAGE, "seq", F.lit("TABLE").alias("block_type"), F.concat_ws(" | ", "l", "r").alias("text"), "x0", "y0", "x1", "y1", F.lit(0.85).alias("confidence"), "width"
    )
    return blocks.join(used, [*PAGE, "seq"], "left_anti").select(*made.columns).unionByName(made)


def section_marks(blocks: DataFrame) -> DataFrame:
    """Adds a ``§ head`` STRUCTURE row above each column that a short label heads, on pages of parallel columns."""
    columned = clusters(blocks.where(_filled(("TEXT", "OCR", "TABLE"))), "x")
    columned = columned.join(multi_column_pages(columned), PAGE, "left_semi")
    heads = columned.groupBy(*PAGE, "cluster").agg(F.count("*").alias("k"), F.min_by(F.struct("seq", "text", "x0", "y0", "x1", "width"), F.struct(_centre("y"), "x0", "seq")).alias("h"))
    line = F.trim(F.get(F.split("h.text", "\n"), F.lit(0)))
    heads = heads.select(*PAGE, "k", "h.*", line.alias("line"))
    narrow = F.col("x1") - F.col("x0") < F.col("width") * 0.35
    heads = heads.where((F.col("k") >= 2) & F.length("line").between(2, 16) & ~F.col("line").contains("|") & ~F.col("line").startswith("§") & narrow)
    marks = heads.select(
        *PAGE, (-F.col("seq") - 1).alias("seq"), F.lit("STRUCTURE").alias("block_type"), F.concat(F.lit("§ "), "line").alias("text"), "x0",
        F.greatest(F.lit(0.0), F.col("y0") - 1).alias("y0"), "x1", F.col("y0").alias("y1"), F.lit(0.7).alias("confidence"), "width",
    )
    return blocks.select(*marks.columns).unionByName(marks)


def page_types(pages: DataFrame, blocks: DataFrame, sparse: int = 40) -> DataFrame:
    """(page, page_type, needs_ocr) from pages (width, height, full_text, text_layer, image_count, drawing_count)."""
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    image = F.col("block_type") == "IMAGE"
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    head, body = F.get(lines, F.lit(0)), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " ")
    kv = F.col("block_type").isin("TEXT", "OCR") & (F.size(lines) >= 2) & (F.length(head) <= 24) & (F.length(body) >= F.greatest(F.lit(18), 2 * F.length(head)))
    text = (F.col("block_type") == "TEXT") & (F.trim("text") != "")
    left, right = text & (F.col("x1") < F.col("width") / 2), text & (F.col("x0") > F.col("width") * 0.45)
    facts = blocks.groupBy(*PAGE).agg(
        F.sum(F.when(image, area)).alias("image_area"), F.count_if(image).alias("images"), F.count_if(kv).alias("kv"), F.count_if(text).alias("texts"),
        F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), F.avg(F.when(left, F.length("text"))).alias("l"), F.avg(F.when(right, F.length("text"))).alias("r"),
    )
    rows = pages.join(facts, PAGE, "left").na.fill(0, ["image_area", "images", "kv", "texts", "n_left", "n_right"])
    full = F.coalesce("full_text", F.lit(""))
    size = F.length(F.trim(full))
    ratio = F.col("image_area") / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    drawn, many = F.col("drawing_count") >= 4, (F.col("image_count") >= 2) | (F.col("images") >= 2)
    dense = (ratio >= 0.35) | ((F.col("images") >= 1) & (ratio >= 0.2))
    thin, medium = size < sparse, (size >= sparse) & (size < 400)
    two = (F.col("texts") >= 6) & (F.col("n_left") >= 3) & (F.col("n_right") >= 3) & (F.col("l") < F.col("r") * 0.6)
    measured = full.rlike("[0-9]") & full.rlike(r"[%+\-]")
    kind = (
        F.when((size < 250) & (dense | drawn | many), "DIAGRAM").when(thin & ~F.col("text_layer"), "SCANNED")
        .when(T.looks_like_table(full) | F.coalesce(two, F.lit(False)) | (F.col("kv") >= 3), F.when(dense, "MIXED").otherwise("TABLE"))
        .when(T.looks_like_chart(full) | (medium & dense & measured), F.when(drawn, "MIXED").otherwise("CHART"))
        .when(dense & medium, "MIXED").when(dense & drawn, "DIAGRAM").otherwise("TEXT")
    )
    rows = rows.withColumn("page_type", kind)
    ocr = (F.col("page_type") == "SCANNED") | ((F.col("page_type") == "DIAGRAM") & (size < 120)) | (thin & ~F.col("text_layer")) | (thin & (dense | many))
    return rows.select(*PAGE, "page_type", ocr.alias("needs_ocr"))
