"""What a section's evidence takes from facts: relevance, choices by ids, catalogs, and lines that a page holds already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words of a section that ask for facts of a kind, and the caps.
METRIC_WORDS = ("성과", "지표", "정량", "효과", "생산", "클레임", "납기", "온도", "효율")
PROCESS_WORDS = ("프로세스", "흐름", "절차", "업무")
ARCHITECTURE_WORDS = ("구성", "아키텍처", "시스템", "인프라")
METRIC_CAP, STRUCTURE_CAP, MISSING_CAP, STATEMENT_CHARS = 8, 4, 12, 180
FEW_METRICS, SURE = 6, 0.7


def ready_sources(sources: DataFrame) -> DataFrame:
    """Sources that serve as evidence."""
    return sources.where((F.col("role") == "EVIDENCE_SOURCE") & (F.col("status") == "READY"))


def wants(kind: str, words: tuple[str, ...]) -> Column:
    """A section (title, objective, required) asks for a kind: it names no types, or that one, or a word of it."""
    named = F.exists("required", lambda t: F.upper(t) == kind)
    said = F.concat_ws(" ", "title", "objective")
    out = F.col("required").isNull() | F.coalesce(named, F.lit(False))
    for w in words:
        out = out | said.contains(w)
    return out


def _overlaps(sections: DataFrame, facts: DataFrame, text: Column, cap: int, order: list[str], key: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(section_id, key): facts that share a token with the section, all that can be among its first ``cap``.

    A fact among the first of a section is among the first of any token that it shares, so ``cap`` facts of a token, by
    ``order``, are enough: a common word meets no more.
    """
    asked = sections.select("section_id", F.explode(T.overlap_tokens(F.concat_ws(" ", "title", "objective"))).alias("_token"))
    told = facts.withColumn("_token", F.explode(T.overlap_tokens(text)))
    told = told.withColumn("_k", F.row_number().over(Window.partitionBy("_token", *within).orderBy(*order, key))).where(F.col("_k") <= cap)
    return asked.join(told.select(key, "_token"), "_token").select("section_id", key).distinct()


def _capped(met: DataFrame, facts: DataFrame, cap: int, order: list[str], key: str) -> DataFrame:
    w = Window.partitionBy("section_id").orderBy(*order, key)
    rows = met.distinct().join(facts, key).withColumn("pos", F.row_number().over(w))
    return rows.where(F.col("pos") <= cap)


def metric_relevance(sections: DataFrame, facts: DataFrame, order: list[str], key: str = "metric_id") -> DataFrame:
    """Facts (metric_id, name, confidence) of every section, the first eight by ``order``.

    A fact that shares a token with the section counts. A section that asks for metrics takes others too, of more than
    six facts only the sure ones. Of those no more than the first eight can count, so that these alone meet every section.
    """
    shared = _overlaps(sections, facts, F.col("name"), METRIC_CAP, order, key)
    sure = facts.crossJoin(F.broadcast(facts.agg(F.count("*").alias("_n"))))  # one row
    sure = sure.where((F.col("_n") <= FEW_METRICS) | (F.coalesce("confidence", F.lit(0.0)) >= SURE))
    first = sure.orderBy(*order, key).limit(METRIC_CAP).select(key)
    asking = sections.where(wants("METRIC", METRIC_WORDS)).select("section_id")
    return _capped(shared.unionByName(asking.crossJoin(F.broadcast(first))), facts, METRIC_CAP, order, key)


def structure_relevance(sections: DataFrame, facts: DataFrame, order: list[str], key: str = "fact_id") -> DataFrame:
    """Facts (fact_id, fact_kind, title, labels array<string>) of every section, the first four of each kind by ``order``."""
    facts = facts.withColumn("fact_kind", F.upper("fact_kind"))
    said = F.concat_ws(" ", "title", F.slice("labels", 1, 8))
    shared = _overlaps(sections, facts, said, STRUCTURE_CAP, order, key, ("fact_kind",))
    out = []
    for kind, words in (("PROCESS", PROCESS_WORDS), ("ARCHITECTURE", ARCHITECTURE_WORDS)):
        mine = facts.where(F.col("fact_kind") == kind)
        first = mine.orderBy(*order, key).limit(STRUCTURE_CAP).select(key)
        asking = sections.where(wants(kind, words)).select("section_id")
        met = shared.join(mine.select(key), key, "left_semi").select("section_id", key)
        out.append(_capped(met.unionByName(asking.crossJoin(F.broadcast(first))), mine, STRUCTURE_CAP, order, key))
    return out[0].unionByName(out[1])


# What a pack says about itself.
LACKS = {"METRIC": "정량 지표 근거가 부족함", "ARCHITECTURE": "아키텍처 근거가 부족함", "PROCESS": "프로세스 근거가 부족함"}
LACKS_ALL = "관련 원문 근거를 충분히 찾지 못함"
NO_CLAIMS = "Evidence Pack에 없는 세부 사실은 단정하지 말 것"
UNLINKED_ARCHITECTURE, UNLINKED_PROCESS = "구성도: 노드 그룹은 확인했으나 연결선 미검증", "흐름도: 단계 목록은 있으나 화살표 연결 미검증"
PACK_CHARS = 400


def section_packs(
    sections: DataFrame, hits: DataFrame, metrics: DataFrame, structures: DataFrame,
    metric_order: list[str] | None = None, structure_order: list[str] | None = None,
) -> DataFrame:
    """One row per section (section_id, title, objective, required): its evidence, what is missing and what limits it.

    ``hits`` (section_id, seq, source_id, page, text, evidence_type) are merged hits, ten of a section or so; blank ones and
    ``[IMAGE]`` are left out, statements are clipped. Definitions stand apart from what supports. ``metrics`` (metric_id,
    name, confidence) and ``structures`` (fact_id, fact_kind, title, labels, page, n_edges) are all facts: of these the relevant
    ones go in, at most eight and four of a kind. A type that the section requires and nothing gives is missing, and so is
    evidence of any kind where there is none. Structures without edges are limits, architectures first. Sections without
    any hit or fact have empty lists.
    """
    item = F.struct("seq", "source_id", "page", T.clip(F.trim("text"), PACK_CHARS).alias("statement"), F.col("evidence_type").alias("type"))
    usable = hits.where((F.trim("text") != "") & (F.trim("text") != "[IMAGE]"))
    defines = F.coalesce(F.col("evidence_type") == "DEFINITION", F.lit(False))
    cited = usable.groupBy("section_id").agg(
        F.array_sort(F.collect_list(F.when(defines, item))).alias("definitions"), F.array_sort(F.collect_list(F.when(~defines, item))).alias("supporting_facts")
    )
    metric = F.struct("pos", "metric_id", "name", "confidence")
    counted = metric_relevance(sections, metrics, metric_order or []).groupBy("section_id").agg(F.array_sort(F.collect_list(metric)).alias("metrics"))
    fact = F.struct("pos", "fact_id", "title", "page", "n_edges")
    kinds = (("PROCESS", "process_facts"), ("ARCHITECTURE", "architecture_facts"))
    drawn = structure_relevance(sections, structures, structure_order or []).groupBy("section_id").agg(
        *(F.array_sort(F.collect_list(F.when(F.col("fact_kind") == kind, fact))).alias(name) for kind, name in kinds)
    )
    rows = sections.join(cited, "section_id", "left").join(counted, "section_id", "left").join(drawn, "section_id", "left")
    none = F.array().cast("array<string>")
    lists = ("definitions", "supporting_facts", "metrics", "process_facts", "architecture_facts")
    rows = rows.withColumns({c: F.coalesce(c, F.from_json(F.lit("[]"), rows.schema[c].dataType)) for c in lists})

    def lacks(kind: str, found: Column) -> Column:
        asked = F.exists(F.coalesce("required", none), lambda t: F.upper(t) == kind)
        return F.when(F.coalesce(asked, F.lit(False)) & ~found, F.lit(LACKS[kind]))

    def holds(name: str, kind: str | None = None) -> Column:
        some = F.size(name) > 0
        return some if kind is None else some | F.coalesce(F.exists("supporting_facts", lambda e: e["type"] == kind), F.lit(False))

    nothing = ~(holds("supporting_facts") | holds("metrics") | holds("process_facts") | holds("architecture_facts"))
    missing = F.array_compact(F.array(
        lacks("METRIC", holds("metrics")), lacks("ARCHITECTURE", holds("architecture_facts", "ARCHITECTURE")),
        lacks("PROCESS", holds("process_facts", "PROCESS")), F.when(nothing, F.lit(LACKS_ALL)),
    ))

    def unlinked(name: str, said: str) -> Column:
        bare = F.filter(name, lambda f: F.coalesce(f["n_edges"], F.lit(0)) == 0)
        return F.transform(bare, lambda f: F.concat(F.lit("p"), F.coalesce(f["page"].cast("string"), F.lit("0")), F.lit(f" {said}")))

    rows = rows.withColumn("missing_evidence", missing)
    general = F.when(F.size("missing_evidence") > 0, F.array(F.lit(NO_CLAIMS))).otherwise(none)
    limits = F.concat(general, unlinked("architecture_facts", UNLINKED_ARCHITECTURE), unlinked("process_facts", UNLINKED_PROCESS))
    return rows.select("section_id", *lists, "missing_evidence", limits.alias("limitations"))


def choose(items: DataFrame, choices: DataFrame) -> DataFrame:
    """Items (section_id, item_id, pos) by the ids of a choice (section_id, keep_ids, drop_ids, ranking), renumbered.

    Dropped ids go; with kept ids only these stay. Ranked ids come first, then kept ones in their order, then the others.
    Ids that the section lacks mean nothing. A choice that leaves nothing, and no choice, leave the items as they are.
    """
    marks = None
    for c in ("keep_ids", "drop_ids", "ranking"):
        told = choices.select("section_id", F.posexplode(c).alias("at", "item_id"), F.lit(c).alias("list"))
        marks = told if marks is None else marks.unionByName(told)
    # The first place of an id in each list, so that items meet their own marks and no list is searched.
    place = lambda c: F.min(F.when(F.col("list") == c, F.col("at")))
    marks = marks.groupBy("section_id", "item_id").agg(place("keep_ids").alias("_keep"), place("drop_ids").alias("_drop"), place("ranking").alias("_rank"))
    rows = items.join(marks, ["section_id", "item_id"], "left")
    same = Window.partitionBy("section_id")
    free = F.col("_drop").isNull()
    rows = rows.withColumn("_keep", F.when(free, F.col("_keep")))
    rows = rows.withColumn("_stays", F.when(F.count("_keep").over(same) > 0, F.col("_keep").isNotNull()).otherwise(free))
    rows = rows.withColumn("_whole", ~F.max("_stays").over(same))
    order = [F.when(~F.col("_whole"), F.col(c)).asc_nulls_last() for c in ("_rank", "_keep")]
    number = F.row_number().over(same.orderBy(*order, "pos"))
    return rows.where("_stays OR _whole").withColumn("pos", number).select(*items.columns)


def merge_missing(first: Column, second: Column) -> Column:
    """Two lists of what is missing: trimmed, without blanks and repeats, the first twelve."""
    said = F.transform(F.concat(first, second), lambda s: F.trim(s))
    return F.slice(F.array_distinct(F.filter(said, lambda s: s != "")), 1, MISSING_CAP)


def catalog(packs: DataFrame, parts: list[tuple[str, str]]) -> DataFrame:
    """(section_id, kind, id, statement, source_id, page) of all items of the packs' typed lists ``(column, kind)``."""
    rows = None
    for column, kind in parts:
        item = packs.select("section_id", F.lit(kind).alias("kind"), F.explode(column).alias("e"))
        item = item.select("section_id", "kind", "e.id", F.substring("e.statement", 1, STATEMENT_CHARS).alias("statement"), "e.source_id", "e.page")
        rows = item if rows is None else rows.unionByName(item)
    return rows


def line_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z가-힣%+\-]", "")


def _same_line(key: Column, old: Column) -> Column:
    short = F.when(F.length(key) <= F.length(old), key).otherwise(old)
    long = F.when(F.length(key) <= F.length(old), old).otherwise(key)
    letters = F.array_distinct(F.split(short, ""))
    shared = F.size(F.filter(letters, lambda c: long.contains(c)))
    alike = (F.length(short) >= 6) & (shared / F.size(letters) >= 0.85) & (F.abs(F.length(key) - F.length(old)) <= 8)
    return (old != "") & ((key == old) | ((F.length(short) >= 4) & long.contains(short)) | alike)


def new_lines(lines: DataFrame, existing: DataFrame) -> DataFrame:
    """Lines (source_id, page, seq, text) that neither the page's texts (source_id, page, text) nor an earlier line hold.

    Keys leave out space and punctuation. A key of under two characters is never new; two are the same if equal, if one
    of four characters or more lies in the other, or if lengths differ by eight at most and the longer one has 85 % of the
    characters of the shorter one, of six or more. A page's lines are folded in order; pages are independent.
    """
    page = ["source_id", "page"]
    old = existing.groupBy(*page).agg(F.collect_set(line_key(F.col("text"))).alias("old"))
    item = F.struct("seq", line_key(F.col("text")).alias("key"), "text")
    rows = lines.groupBy(*page).agg(F.array_sort(F.collect_list(item)).alias("items")).join(old, page, "left")
    start = F.struct(F.coalesce("old", F.array().cast("array<string>")).alias("keys"), F.slice("items", 1, 0).alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        known = (F.length(line["key"]) < 2) | F.exists(acc["keys"], lambda k: _same_line(line["key"], k))
        keys = F.when(known, acc["keys"]).otherwise(F.concat(acc["keys"], F.array(line["key"])))
        kept = F.when(known, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line)))
        return F.struct(keys.alias("keys"), kept.alias("kept"))

    kept = rows.select(*page, F.explode(F.aggregate("items", start, step, lambda acc: acc["kept"])).alias("line"))
    return kept.select(*page, "line.seq", "line.text")


def blocks_of(evidence: DataFrame, blocks: DataFrame, fallback: int = 3) -> DataFrame:
    """(evidence_id, block_id) of evidence (evidence_id, source_id, page, block_ids): its blocks, else the first three of its page."""
    named = evidence.select("evidence_id", F.explode("block_ids").alias("block_id")).join(blocks.select("block_id").distinct(), "block_id", "left_semi")
    named = named.select("evidence_id", "block_id").distinct()
    bare = evidence.join(named, "evidence_id", "left_anti")
    w = Window.partitionBy("source_id", "page").orderBy("seq", "block_id")
    first = blocks.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= fallback)
    return named.unionByName(bare.select("evidence_id", "source_id", "page").join(first, ["source_id", "page"]).select("evidence_id", "block_id"))


def outcomes(sections: DataFrame) -> DataFrame:
    """Per edition of sections (edition_id, decision, status): counts of decisions, whether all passed, whether any needs a person."""
    return sections.groupBy("edition_id").agg(
        F.count_if(F.col("decision") == "KEEP").alias("kept"), F.count_if(F.col("decision") != "KEEP").alias("rewritten"),
        F.every(F.coalesce(F.col("status") == "PASSED", F.lit(False))).alias("all_passed"),
        F.coalesce(F.some(F.col("status") == "MANUAL_REVIEW"), F.lit(False)).alias("manual_review"),
    )


# Kinds of pages, counts and words.
GRAPH_PAGES = ("DIAGRAM", "MIXED", "CHART")
TECH_WORDS = ("시스템", "클라우드", "서버", "네트워크", "데이터", "공정", "모델", "센서")
LEAST_BYTES, TITLE_CHARS = 32, 40


def holds_graph(pages: DataFrame, blocks: DataFrame, drawings: DataFrame) -> DataFrame:
    """Pages (source_id, page, page_type) with ``holds_graph``: enough short texts or lines for a diagram, and few tables."""
    key = ["source_id", "page"]
    head = F.trim(F.substring_index("text", "\n", 1))
    text = F.col("block_type").isin("TEXT", "OCR") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    short = text & F.length(head).between(2, 22) & ~head.contains("|")
    counted = blocks.groupBy(*key).agg(
        F.count_if(text).alias("_texts"), F.count_if(F.col("block_type") == "TABLE").alias("_tables"), F.count_if(short).alias("_short")
    )
    drawn = drawings.groupBy(*key).agg(F.count_if(F.col("kind") == "line").alias("_lines"))
    rows = pages.join(counted, key, "left").join(drawn, key, "left").na.fill(0, ["_texts", "_tables", "_short", "_lines"])
    many = (F.col("_lines") >= 6) | (F.col("_short") >= 10) | ((F.col("page_type") == "DIAGRAM") & (F.col("_short") >= 6) & (F.col("_lines") >= 2))
    usable = F.col("page_type").isin(*GRAPH_PAGES) & (F.col("_texts") >= 5) & (F.col("_tables") < 5)
    return rows.withColumn("holds_graph", usable & many).drop("_texts", "_tables", "_short", "_lines")


def unrendered(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(section_id, unrendered): visuals (section_id, asset_id, path) without a file (path, n_bytes) of 32 bytes or more."""
    lost = assets.join(files.where(F.col("n_bytes") >= LEAST_BYTES).select("path"), "path", "left_anti")
    return lost.groupBy("section_id").agg(F.count("*").alias("unrendered"))


def looks_technical(term: Column) -> Column:
    out = term.rlike("[A-Za-z]") & (F.length(term) <= 24)
    for w in TECH_WORDS:
        out = out | term.contains(w)
    return out


def short_title(text: Column, fallback: Column) -> Column:
    """White space collapsed; past 40 characters the first 37 and an ellipsis; the fallback where nothing is left."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > TITLE_CHARS, F.concat(F.substring(flat, 1, TITLE_CHARS - 3), F.lit("..."))).when(flat == "", fallback).otherwise(flat)


def last_two(editions: DataFrame, key: str, number: str, id_col: str) -> DataFrame:
    """(key, older, newer) to compare: the last two by number; a single one stands on both sides."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(number), F.desc(id_col)))
    best = editions.select(key, id_col, place.alias("_k")).where("_k <= 2").groupBy(key)  # Spark keeps two of a key before the shuffle
    best = best.agg(F.max(F.when(F.col("_k") == 2, F.col(id_col))).alias("older"), F.max(F.when(F.col("_k") == 1, F.col(id_col))).alias("newer"))
    return best.select(key, F.coalesce("older", "newer").alias("older"), "newer")


def pack_metrics(packs: DataFrame) -> DataFrame:
    """All metrics of all packs (section_id, metrics), with their section."""
    return packs.select("section_id", F.explode("metrics").alias("m")).select("section_id", "m.*")


def pack_pages(packs: DataFrame, lists: list[str]) -> DataFrame:
    """(section_id, source_id, page) that the items of the typed lists come from, each once."""
    every = F.flatten(F.array(*(F.transform(c, lambda e: F.struct(e["source_id"].alias("source_id"), e["page"].alias("page"))) for c in lists)))
    return packs.select("section_id", F.explode(F.array_distinct(every)).alias("p")).select("section_id", "p.*")


def pack_numbers(metrics: DataFrame) -> DataFrame:
    """(section_id, value): change, baseline and result values of the sections' metrics, each once."""
    values = F.array_compact(F.array(*(F.col(c).cast("double") for c in ("change_value", "baseline_value", "result_value"))))
    return metrics.select("section_id", F.explode(values).alias("value")).distinct()
