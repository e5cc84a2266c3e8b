"""From code files to the catalog, lineage and registry tables.

The mined tables are small next to the files and are read by many later steps, so each
is written once to the shared folder; the files are scanned once per table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import is_code_path
from tidemark.functions.text import has_text
from tidemark.operators import catalog, chunking, graph, lineage, mining, workflows
from tidemark.session import materialise
from tidemark.sources.code_tree import read_code_tree


@dataclass
class Corpus:
    """Every table mined from (file_ord, path, content) rows, each planned once."""

    all_files: DataFrame

    @staticmethod
    def of_tree(spark: SparkSession, path: str) -> Corpus:
        """The corpus of a code tree, whose files are opened once and kept as one table."""
        return Corpus(materialise(read_code_tree(spark, path), "code-files"))

    @cached_property
    def files(self) -> DataFrame:
        return self.all_files.where(is_code_path(F.col("path")) & has_text(F.col("content")))

    @cached_property
    def chunks(self) -> DataFrame:
        return chunking.line_chunks(self.files)

    @cached_property
    def texts(self) -> DataFrame:
        return mining.sql_texts(self.files)

    @cached_property
    def blocks(self) -> DataFrame:
        return mining.create_table_blocks(self.texts)

    @cached_property
    def definitions(self) -> DataFrame:
        return mining.table_definitions(self.blocks)

    @cached_property
    def catalog(self) -> DataFrame:
        merged = catalog.merge_definitions(self.definitions)
        return materialise(mining.tag_pii(merged), "catalog")

    @cached_property
    def raw_edges(self) -> DataFrame:
        return mining.raw_edges(self.files, self.texts)

    @cached_property
    def lineage(self) -> DataFrame:
        return materialise(lineage.merge_edges(self.raw_edges, self.catalog), "lineage")

    @cached_property
    def nodes(self) -> DataFrame:
        return lineage.node_set(self.lineage, self.catalog)

    @cached_property
    def read_workflows(self) -> DataFrame:
        return materialise(workflows.read_workflows(self.files), "workflow-files")

    @cached_property
    def dags(self) -> DataFrame:
        return workflows.definitions(self.read_workflows)

    @cached_property
    def skipped(self) -> DataFrame:
        return workflows.skipped_files(self.read_workflows)

    @cached_property
    def registry(self) -> DataFrame:
        return workflows.registry(self.dags)

    @cached_property
    def levels(self) -> DataFrame:
        return graph.levels(self.nodes, self.lineage)
