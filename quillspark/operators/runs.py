"""Production of an edition's sections in waves that can stop anywhere: what is done is a ledger, what is left an anti-join.

A wave is many sections at once. For each wave the steps ``text``, ``claims`` and ``version`` write their tables, and the
ledger then takes a row (edition_id, section_id, step, input_hash) for each section. A run that starts again joins its
sections against the ledger and does what is not there; a section whose input has changed has another hash and is done
again. Writes go by section or by batch, so that a step that wrote but did not come to its ledger row changes nothing when
it is repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..sources.versioned import VersionedTables
from . import quality, records, report
from .editions import is_complete

STEPS = ("text", "claims", "version")
LEDGER = "run_ledger"


def section_id(edition_id: str, node: Column | str = "node_id") -> Column:
    return content_id("SEC", F.lit(edition_id), node)


class EditionRun:
    """One edition's run over its tables ``sections``, ``claims``, ``section_versions`` and the ledger."""

    def __init__(self, tables: VersionedTables, edition_id: str, wave_size: int = 1000, watch: Callable[[str, int], None] = lambda step, wave: None):
        self.tables, self.edition_id, self.wave_size, self.watch = tables, edition_id, wave_size, watch

    def _read(self, name: str, schema: str) -> DataFrame:
        if self.tables.exists(name):
            return self.tables.read(name)
        return self.tables.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read(LEDGER, "edition_id string, section_id string, step string, input_hash string").where(F.col("edition_id") == self.edition_id)

    def sections(self) -> DataFrame:
        rows = self._read("sections", "section_id string, edition_id string, node_id string, title string, objective string, content_markdown string, status string, seq int")
        return rows.where(F.col("edition_id") == self.edition_id)

    def inputs(self, nodes: DataFrame, evidence: DataFrame, parents: DataFrame | None = None) -> DataFrame:
        """Nodes (node_id, title, objective, order) with section_id, the parent's text if they inherit one, and a hash of all that
        their section is made of. evidence is by node_id; parents (node_id, content_markdown) are texts to take over."""
        rows = nodes.select("node_id", "title", "objective", F.col("order").alias("seq")).withColumn("section_id", section_id(self.edition_id))
        order = [c for c in evidence.columns if c != "node_id"]
        packs = evidence.groupBy("node_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*order)))), 256).alias("_pack"))
        rows = rows.join(packs, "node_id", "left")
        if parents is None:
            rows = rows.withColumn("inherited", F.lit(None).cast("string"))
        else:
            rows = rows.join(parents.select("node_id", F.col("content_markdown").alias("inherited")), "node_id", "left")
        return rows.withColumn("input_hash", F.sha2(F.to_json(F.struct("title", "objective", "seq", "inherited", "_pack")), 256)).drop("_pack")

    def left(self, inputs: DataFrame, step: str) -> DataFrame:
        """Inputs of which the ledger has no row for a step."""
        done = self.ledger().where(F.col("step") == step).select("section_id", "input_hash")
        return inputs.join(done, ["section_id", "input_hash"], "left_anti")

    def unfinished(self, nodes: DataFrame) -> DataFrame:
        """Nodes without a section that is complete, whoever wrote it."""
        done = self.sections().where(is_complete()).select("node_id")
        return nodes.join(done, "node_id", "left_anti")

    def resumable(self, nodes: DataFrame) -> bool:
        """The edition is being produced and some node has no complete section."""
        return not self.unfinished(nodes).isEmpty()

    def run(self, nodes: DataFrame, evidence: DataFrame, parents: DataFrame | None = None) -> int:
        """Do all that is left; gives the number of sections that were written."""
        spark, folder = self.tables.spark, f"{self.tables.root}/_inputs/{uuid.uuid4().hex}"
        self.inputs(nodes, evidence, parents).write.parquet(folder)
        inputs = spark.read.parquet(folder)
        open_ = self.left(inputs, STEPS[-1])
        # Waves follow the order of the nodes, not what is left, so that they are the same in every run.
        waves = [r["wave"] for r in open_.select(F.floor(F.col("seq") / self.wave_size).cast("int").alias("wave")).distinct().collect()]
        written = 0
        for wave in sorted(waves):
            mine = inputs.where(F.floor(F.col("seq") / self.wave_size) == wave)
            for step in STEPS:
                todo = self.left(mine, step)
                n = todo.count()
                if not n:
                    continue
                getattr(self, f"_{step}")(todo, evidence)
                self.watch(step, wave)
                rows = todo.select(F.lit(self.edition_id).alias("edition_id"), "section_id", F.lit(step).alias("step"), "input_hash")
                written += n if step == STEPS[-1] else 0
                self.tables.upsert(LEDGER, rows, ["edition_id", "section_id", "step"], key="section_id", known=rows)
        return written

    def _packs(self, todo: DataFrame, evidence: DataFrame) -> DataFrame:
        return evidence.join(todo.select("node_id", "section_id"), "node_id").drop("node_id")

    def _text(self, todo: DataFrame, evidence: DataFrame) -> None:
        """New sections are written from their evidence; inherited ones keep their text but for what the evidence lacks."""
        packs = self._packs(todo, evidence)
        fresh = report.write_sections(todo.where("inherited IS NULL").select("section_id", "title", "objective"), packs).select("section_id", "content_markdown")
        numbers = packs.select("section_id", F.explode(_numbers(packs)).alias("value"))
        old = todo.where("inherited IS NOT NULL").select("section_id", F.col("inherited").alias("content_markdown"))
        kept = quality.scrub(old, packs.where("source_id IS NOT NULL").select("section_id", "source_id", "page"), numbers)
        texts = fresh.unionByName(kept.select("section_id", "content_markdown"))
        rows = todo.join(texts, "section_id").select(
            "section_id", F.lit(self.edition_id).alias("edition_id"), "node_id", "title", "objective", "content_markdown", F.lit("DRAFT").alias("status"), "seq"
        )
        self.tables.upsert("sections", rows, ["section_id"], known=todo)

    def _claims(self, todo: DataFrame, evidence: DataFrame) -> None:
        texts = self.sections().join(todo.select("section_id"), "section_id", "left_semi").select("section_id", "title", "content_markdown")
        self.tables.replace_keys("claims", report.claims(texts, self._packs(todo, evidence)), "section_id", keys=todo.select("section_id"))

    def _version(self, todo: DataFrame, evidence: DataFrame) -> None:
        """The next version of each text; a version of the same input is not added again."""
        texts = self.sections().join(todo.select("section_id", "input_hash", "inherited"), "section_id")
        reason = F.when(F.col("inherited").isNotNull(), "inherited from parent").otherwise("written")
        rows = texts.select("section_id", "content_markdown", reason.alias("reason"), F.col("input_hash").alias("created_at"))
        if self.tables.exists("section_versions"):
            rows = rows.join(self.tables.read("section_versions").select("section_id", "created_at"), ["section_id", "created_at"], "left_anti")
        records.add_section_versions(self.tables, rows)

    def regenerate(self, nodes: DataFrame, evidence: DataFrame, node_id: str) -> int:
        """Write one section again from today's evidence; a node that the outline lacks takes title and objective of its section."""
        one = nodes.where(F.col("node_id") == node_id)
        if one.isEmpty():
            one = self.sections().where(F.col("node_id") == node_id).select("node_id", "title", "objective", F.col("seq").alias("order"))
        return self.run(one, evidence)


def _numbers(packs: DataFrame) -> Column:
    """Numbers that a pack's statements hold: percent values, and a metric's own value."""
    from ..functions import text as T

    said = T.percents(F.coalesce("statement", F.lit("")))
    return F.concat(said, F.array_compact(F.array(F.col("value").cast("double")))) if "value" in packs.columns else said
