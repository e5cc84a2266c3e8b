"""Resolving table names and merging lineage edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import is_table_name
from tidemark.operators.mining import EDGE_ORDER
from tidemark.session import materialise


def resolve_names(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Map each lower-cased ``name`` to the catalog name it stands for.

    First choice is the first catalog name equal to name, name+s or name+es (ignoring
    case), second the first one that starts with it. Both are equality joins: the
    name is spelled out in its three forms, the catalog in those beginnings of its names
    that are as long as a name left over, and only the first entry per beginning is kept
    before joining.
    Names with no match are left out.
    """
    known = catalog.select(
        F.lower("name").alias("spelling"), F.struct("ordinal", "name").alias("entry")
    )
    exact = known.groupBy("spelling").agg(F.min("entry").alias("entry"))
    forms = names.select(
        "name",
        F.explode(
            F.array("name", F.concat("name", F.lit("s")), F.concat("name", F.lit("es")))
        ).alias("spelling"),
    )
    by_form = (
        forms.join(exact, "spelling")
        .groupBy("name")
        .agg(F.min("entry").alias("entry"))
    )
    open_names = names.join(by_form.select("name"), "name", "left_anti")
    lengths = open_names.agg(F.collect_set(F.length("name"))).scalar()  # one entry per length of a name
    beginnings = (
        known.select("spelling", "entry", F.explode(lengths).alias("n")).where(F.col("n").between(1, F.length("spelling")))
        .groupBy(F.left("spelling", F.col("n")).alias("name"))
        .agg(F.min("entry").alias("entry"))
    )
    unmatched = F.when(F.col("by_form").isNull(), F.col("name"))
    return (
        names.join(by_form.withColumnRenamed("entry", "by_form"), "name", "left")
        .withColumn("beginning", unmatched)
        .join(beginnings.select(F.col("name").alias("beginning"), "entry"), "beginning", "left")
        .select("name", F.coalesce("by_form.name", "entry.name").alias("resolved"))
        .where(F.col("resolved").isNotNull())
    )


def merge_edges(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolve both ends, drop self edges and invalid names, keep the first per pair.

    Edges are cut to the first per spelled pair before any join, so a table read by a
    third of all statements is shuffled once per distinct pair only. What is left of a
    hot name is split by adaptive skew handling; the looked-up side is unique per name.
    The pairs are written, so the files behind the edges are read once.
    """
    order = F.struct(*EDGE_ORDER)
    payload = F.struct("source", "target", "transformation", "file")
    pairs = materialise(
        edges.groupBy(F.lower("source").alias("from_name"), F.lower("target").alias("to_name"))
        .agg(F.min(order).alias("place"), F.min_by(payload, order).alias("edge")),
        "edge-pairs",
    )
    names = (
        pairs.select(F.explode(F.array("from_name", "to_name")).alias("name")).distinct()
    )
    found = materialise(resolve_names(names, catalog), "resolved-names")
    resolved = (
        pairs.join(found.select(F.col("name").alias("from_name"), F.col("resolved").alias("r_from")), "from_name", "left")
        .join(found.select(F.col("name").alias("to_name"), F.col("resolved").alias("r_to")), "to_name", "left")
        .select(
            F.coalesce("r_from", "edge.source").alias("source"),
            F.coalesce("r_to", "edge.target").alias("target"),
            F.col("edge.transformation").alias("transformation"),
            F.col("edge.file").alias("file"),
            "place",
        )
        .where(
            (F.lower("source") != F.lower("target"))
            & is_table_name(F.col("source"))
            & is_table_name(F.col("target"))
        )
    )
    return (
        resolved.groupBy(F.lower("source").alias("s"), F.lower("target").alias("t"))
        .agg(F.min_by(payload, F.col("place")).alias("edge"))
        .select("edge.*")
    )


def node_set(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """All edge ends and all tables with columns, once each."""
    return (
        edges.select(F.explode(F.array("source", "target")).alias("id"))
        .union(catalog.where(F.size("columns") > 0).select("name"))
        .distinct()
        .withColumn("label", F.col("id"))
    )


def table_workflows(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Which workflows feed or read a table: edges and workflows of the same file."""
    tables = edges.select(
        F.explode(F.array("source", "target")).alias("table"), F.col("file").alias("source_file")
    ).distinct()
    return tables.join(registry.select("source_file", "dag_id"), "source_file").select(
        "table", "dag_id"
    ).distinct()


def workflow_owners(registry: DataFrame) -> DataFrame:
    return registry.select("dag_id", F.explode("owners").alias("owner"))
