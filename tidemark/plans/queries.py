"""Every operator as a query over the supplied tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import schemas
from tidemark.functions import names, scoring
from tidemark.functions.text import has_text
from tidemark.operators import (
    catalog,
    chunking,
    graph,
    health,
    lineage,
    mining,
    quality,
    reports,
    retrieval,
    workflows,
)
from tidemark.operators.vector_index import VectorIndex
from tidemark.plans import actions, flows
from tidemark.plans.corpus import Corpus
from tidemark.plans.inputs import table, view
from tidemark.session import materialise, shared_path
from tidemark.sources import stores
from tidemark.sources.code_tree import read_code_tree, write_code_tree
from tidemark.sources.delimited import read_delimited
from tidemark.streaming import incremental

Query = Callable[..., DataFrame]
QUERIES: dict[str, Query] = {}

CSV_COLUMNS = ["id", "amount", "qty", "order_date", "email", "status"]
CSV_TYPES = {"id": "bigint", "amount": "double", "qty": "int", "order_date": "date"}
VECTOR_DIM = 128


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


class Inputs:
    """The supplied tables and what several queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def path(self, label: str) -> str:
        return shared_path(self.spark, label)

    @cached_property
    def corpus(self) -> Corpus:
        """The corpus of the code files, which are made and written once: most steps scan them."""
        return Corpus(materialise(self.view("code_files"), "code-files"))

    @cached_property
    def registry(self) -> DataFrame:
        """The flat registry view in the form of the registry table."""
        tasks = F.transform(
            F.filter(F.sequence(F.lit(0), F.col("n_tasks")), lambda i: i > 0),
            lambda i: F.concat(F.lit("task_"), i.cast("string")),
        )
        return self.view("dag_registry").select(
            "dag_id", "schedule", tasks.alias("tasks"), F.array("owner").alias("owners"),
            F.array().cast("array<string>").alias("tags"), "source_file", F.lit("").alias("description"),
            F.lit(False).alias("catchup"), F.lit(1).cast("long").alias("max_active_runs"),
        )

    @cached_property
    def health(self) -> DataFrame:
        return health.health_from_runs(self.view("run_log"), self.registry)

    @cached_property
    def pipelines(self) -> DataFrame:
        return health.pipelines(self.health, self.registry)

    @cached_property
    def csv(self) -> DataFrame:
        return self.view("raw_csv")

    @cached_property
    def chunks(self) -> DataFrame:
        """Chunks of all documents, dealt by id and written once: vectors, hits and prompts read them."""
        return materialise(chunking.line_chunks(self.view("text_files")).repartition("id"), "chunks")

    @cached_property
    def slotted(self) -> DataFrame:
        """The slots of the words of every chunk, written once: weights and vectors are made of them."""
        return materialise(self.chunks.select("id", retrieval.word_slots(F.col("text"), VECTOR_DIM).alias("slots")), "slots")

    @cached_property
    def weights(self) -> retrieval.TermWeights:
        return retrieval.TermWeights.fit(self.slotted, VECTOR_DIM)

    @cached_property
    def hits(self) -> DataFrame:
        """The chunks closest to the last user turn of every conversation."""
        queries = retrieval.question_vectors(self.table("conversations"), self.weights)
        return materialise(retrieval.cosine_top_k(queries, self.weights.encode(self.slotted)), "hits")

    @cached_property
    def words(self) -> DataFrame:
        """All distinct words of the code files."""
        found = F.regexp_extract_all("content", F.lit(r"\w+"), 0)
        return self.view("code_files").select(F.explode(found).alias("word")).distinct()

    @cached_property
    def snapshots(self) -> DataFrame:
        """Events read as progress reports of runs."""
        return progress_snapshots(self.table("events"))


def progress_snapshots(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("run_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("stage"),
        F.floor("value").alias("current"),
        (F.col("event_id") % 120).alias("total"),
        F.col("props").alias("message"),
        (F.col("event_type") == "purchase").alias("done"),
    )


# -- sources and sinks -----------------------------------------------------------------


@query
def a1_code_tree_scan(data: Inputs) -> DataFrame:
    folder = data.path("code-tree")
    write_code_tree(data.view("code_files"), folder)
    return read_code_tree(data.spark, folder).select("path", "content")


@query
def a2_delimited_scan(data: Inputs) -> DataFrame:
    folder = data.path("delimited") + ".csv"
    data.csv.drop("row_id").write.csv(folder, header=True, emptyValue="")
    return read_delimited(data.spark, folder).drop("row_id")


@query
def a3_catalog_listing(data: Inputs) -> DataFrame:
    return catalog.listing(data.corpus.catalog).select(
        "name", F.array_join("columns", ",").alias("columns"),
        F.size("pii_columns").alias("n_pii"), "source_file", "has_pii",
    )


@query
def a4_full_refresh(data: Inputs) -> DataFrame:
    path = data.path("lineage")
    stores.full_refresh(data.corpus.raw_edges.select("source", "target", "transformation", "file"), path)
    stores.full_refresh(data.corpus.lineage, path)
    return stores.read_table(data.spark, path, schemas.LINEAGE)


@query
def a5_guarded_refresh(data: Inputs) -> DataFrame:
    path = data.path("registry")
    stores.guarded_refresh(data.corpus.registry, path)
    stores.guarded_refresh(workflows.registry(workflows.parse_workflows(data.view("text_files"))), path)
    return stores.read_table(data.spark, path, ", ".join(f"{n} {t}" for n, t in data.corpus.registry.dtypes)).select(
        "dag_id", "schedule", F.size("tasks").alias("n_tasks"), "source_file"
    )


@query
def a6_vector_upsert(data: Inputs) -> DataFrame:
    path, files = data.path("vectors"), data.view("text_files")
    stores.write_batch(chunking.line_chunks(files), path, 0, reset=True)
    changed = files.where(F.col("path").startswith("docs/src1/")).withColumn("content", F.reverse("content"))
    stores.write_batch(chunking.line_chunks(changed), path, 1)
    schema = schemas.CHUNK_VECTORS.replace(", embedding array<float>", "")
    return stores.read_store(data.spark, path, schema).select("id", "file", "chunk", F.md5("text").alias("text_md5"))


@query
def a7_run_state(data: Inputs) -> DataFrame:
    return stores.latest_state(data.table("events"), "user_id", "props", ["ts", "event_id"])


@query
def a8_json_report(data: Inputs) -> DataFrame:
    path, found = data.path("report-json"), data.corpus
    totals = reports.summary(found.catalog, found.nodes, found.lineage, data.pipelines)
    rows = reports.json_rows(found.catalog, found.nodes, found.lineage, data.pipelines, totals)
    reports.write_json(rows, path)
    return data.spark.read.text(path).groupBy("section").agg(F.count("*").alias("entries"))


@query
def a8_json_lineage(data: Inputs) -> DataFrame:
    path, found = data.path("report-json"), data.corpus
    totals = reports.summary(found.catalog, found.nodes, found.lineage, data.pipelines)
    reports.write_json(reports.json_rows(found.catalog, found.nodes, found.lineage, data.pipelines, totals), path)
    items = data.spark.read.text(path)
    edges = items.where("section = 'lineage_edges'").select(F.from_json("value", schemas.LINEAGE).alias("e")).select("e.*")
    nodes = items.where("section = 'lineage_nodes'").select(F.from_json("value", "id string, label string").alias("n"))
    return edges.unionByName(
        nodes.select(
            F.col("n.id").alias("source"), F.col("n.label").alias("target"), F.lit("NODE").alias("transformation"), F.lit("").alias("file")
        )
    )


def _csv_section(data: Inputs, section: str) -> DataFrame:
    """One section of the CSV report, written with all others and read back as texts."""
    path, found = data.path("report-csv"), data.corpus
    totals = reports.summary(found.catalog, found.nodes, found.lineage, data.pipelines)
    reports.write_csv(reports.csv_sections(found.catalog, found.lineage, data.pipelines, totals), path)
    return data.spark.read.csv(f"{path}/{section}", header=True, escape='"', emptyValue="", nullValue="\0")


@query
def a9_csv_report(data: Inputs) -> DataFrame:
    return _csv_section(data, "data_catalog").select(
        F.col("Table Name").alias("name"), F.col("Has PII").alias("has_pii"),
        F.col("Column Count").cast("int").alias("n_columns"), F.col("Columns").alias("columns"),
        F.col("PII Columns").alias("pii"),
    )


@query
def a9_csv_lineage(data: Inputs) -> DataFrame:
    return _csv_section(data, "data_lineage").toDF("source", "target", "transformation", "file")


@query
def a9_csv_pii_audit(data: Inputs) -> DataFrame:
    return _csv_section(data, "pii_audit").toDF("table", "source_file", "column", "pii_types")


@query
def a9_csv_health(data: Inputs) -> DataFrame:
    return _csv_section(data, "pipeline_health").select(
        F.col("DAG ID").alias("dag_id"), F.coalesce("Status", F.lit("")).alias("status"), F.col("SLO OK").alias("slo_ok"),
        F.col("Success Rate %").cast("double").alias("success_rate"), F.col("Failure Count").cast("long").alias("failure_count"),
        F.coalesce("Last Error", F.lit("")).alias("last_error"),
    )


@query
def a9_csv_summary(data: Inputs) -> DataFrame:
    rows = _csv_section(data, "summary").toDF("metric", "value")
    return rows.where(~F.col("metric").isin("Generated At", "SLO %"))


@query
def a10_preview(data: Inputs) -> DataFrame:
    return quality.preview(data.csv, "row_id").select("row_id", F.explode("row").alias("column", "value"))


# -- scalar functions --------------------------------------------------------------------


@query
def b1_file_type(data: Inputs) -> DataFrame:
    return data.view("code_files").select("path", names.file_type(F.col("path")).alias("type"))


@query
def b2_code_paths(data: Inputs) -> DataFrame:
    return data.view("code_files").select("path", names.is_code_path(F.col("path")).alias("eligible"))


@query
def b3_nonblank_files(data: Inputs) -> DataFrame:
    both = data.view("code_files").unionByName(data.view("text_files"))
    return chunking.nonblank_files(both).select("path", F.length("content").alias("n_chars"))


@query
def b4_table_names(data: Inputs) -> DataFrame:
    return data.words.select("word", names.is_table_name(F.col("word")).alias("valid"))


@query
def b5_pii_types(data: Inputs) -> DataFrame:
    return data.words.select("word", F.array_join(names.pii_types(F.col("word")), "+").alias("types"))


@query
def b6_pii_flag(data: Inputs) -> DataFrame:
    return data.words.select("word", names.is_pii(F.col("word")).alias("is_pii"))


@query
def b7_catalog_search(data: Inputs) -> DataFrame:
    return catalog.search(data.corpus.catalog, "ADDRESS").select("name")


@query
def b8_catalog_categories(data: Inputs) -> DataFrame:
    listed = F.array(
        *(F.when(catalog.matches_category(c), F.lit(c)) for c in ("all", "pii", "clean", "rich"))
    )
    return data.corpus.catalog.select("name", F.explode(F.array_compact(listed)).alias("category"))


@query
def b9_health_categories(data: Inputs) -> DataFrame:
    listed = F.array(
        *(F.when(health.in_category(c), F.lit(c)) for c in ("all", "failed", "slo", "ok", "real"))
    )
    return data.pipelines.select("dag_id", F.explode(F.array_compact(listed)).alias("category"))


@query
def b10_b11_b12_display_strings(data: Inputs) -> DataFrame:
    return catalog.overview(data.corpus.catalog)


@query
def b13_expected_duration(data: Inputs) -> DataFrame:
    return data.registry.select("dag_id", scoring.expected_duration(F.size("tasks")).alias("expected_s"))


@query
def b14_b15_b16_b17_health_scores(data: Inputs) -> DataFrame:
    return data.pipelines.select(
        "dag_id", "slo_ok", "success_rate", F.bround("slo_bar", 6).alias("slo_bar"), "rich"
    )


@query
def b18_score_bands(data: Inputs) -> DataFrame:
    pipelines = data.pipelines.select(
        F.col("dag_id").alias("item"), scoring.quality_band(F.col("success_rate")).alias("band")
    )
    columns = quality.null_profile(data.csv, CSV_COLUMNS).select(
        F.col("column").alias("item"), scoring.null_band(F.col("null_pct")).alias("band")
    )
    return pipelines.unionByName(columns)


@query
def b19_chunk_ids(data: Inputs) -> DataFrame:
    return chunking.line_chunks(data.view("text_files")).select("file", "chunk", "id")


@query
def b20_progress_percent(data: Inputs) -> DataFrame:
    return data.snapshots.select(
        "seq", scoring.progress_pct(F.col("current"), F.col("total")).alias("pct")
    )


@query
def b21_b22_workflow_defaults(data: Inputs) -> DataFrame:
    return data.corpus.dags.select(
        "source_file", "dag_id", "schedule", F.array_join("tags", ",").alias("tags"),
        F.array_join("owners", ",").alias("owners"), "description", "catchup", "max_active_runs",
    )


# -- text mining -------------------------------------------------------------------------


@query
def c1_embedded_sql(data: Inputs) -> DataFrame:
    return data.corpus.texts.select("path", "text_ord", F.md5("sql").alias("sql_md5"))


@query
def c2_create_table_blocks(data: Inputs) -> DataFrame:
    return data.corpus.blocks.select("path", "text_ord", "block_ord", "name", F.md5("body").alias("body_md5"))


@query
def c3_columns(data: Inputs) -> DataFrame:
    return data.corpus.definitions.select(
        "path", "text_ord", "block_ord", "name", F.posexplode("columns").alias("pos", "column")
    )


EDGE_COLUMNS = [*mining.EDGE_ORDER, "source", "target", "transformation", "file"]


@query
def c4_insert_edges(data: Inputs) -> DataFrame:
    return mining.insert_edges(data.corpus.texts).select(*EDGE_COLUMNS)


@query
def c5_variable_edges(data: Inputs) -> DataFrame:
    return mining.variable_edges(data.corpus.files).select(*EDGE_COLUMNS)


@query
def c6_workflow_files(data: Inputs) -> DataFrame:
    return workflows.workflow_files(data.corpus.files).select("path")


@query
def c7_workflow_definitions(data: Inputs) -> DataFrame:
    return data.corpus.dags.select(
        "source_file", "dag_ord", "dag_id", "schedule", F.array_join("tasks", ",").alias("tasks"),
        F.array_join("owners", ",").alias("owners"), "by_syntax",
    )


@query
def c8_pattern_definitions(data: Inputs) -> DataFrame:
    return workflows.pattern_workflows(data.corpus.files).select(
        "source_file", "dag_id", "schedule", F.array_join("tasks", ",").alias("tasks"),
        F.array_join("owners", ",").alias("owners"), F.array_join("tags", ",").alias("tags"),
    )


@query
def c9_tasks(data: Inputs) -> DataFrame:
    return data.corpus.dags.select(
        "source_file", "dag_ord", F.posexplode("tasks").alias("pos", "task_id")
    )


@query
def c10_exploded_lists(data: Inputs) -> DataFrame:
    known = data.corpus.registry
    parts = [workflows.exploded(known, c).withColumn("list", F.lit(c)) for c in ("owners", "tags", "tasks")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- chunks, vectors, prompts ----------------------------------------------------------------


@query
def d1_line_chunks(data: Inputs) -> DataFrame:
    return chunking.line_chunks(data.view("text_files")).select("file", "chunk", "type", F.md5("text").alias("text_md5"))


@query
def d1_markup_chunks(data: Inputs) -> DataFrame:
    pages = data.table("pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    return chunking.line_chunks(pages).select("file", "chunk", F.md5("text").alias("text_md5"))


@query
def d2_chunk_vectors(data: Inputs) -> DataFrame:
    vectors = data.weights.encode(data.slotted)
    return (
        vectors.select("id", F.posexplode("embedding").alias("slot", "weight"))
        .where(F.col("weight") != 0)
        .select("id", "slot", F.round(F.col("weight").cast("double"), 4).alias("weight"))
    )


def _vectors(data: Inputs) -> tuple[DataFrame, DataFrame]:
    """The mean vector of every label as queries, all vectors as the store."""
    rows = data.table("embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "mean")))  # as many as a vector has components
    centroids = means.groupBy(F.col("label").alias("query_id")).agg(F.transform(ordered, lambda m: m["mean"]).alias("embedding"))
    return centroids, rows.select(F.col("vec_id").alias("id"), "embedding")


@query
def d3_cosine_top_k(data: Inputs) -> DataFrame:
    return retrieval.cosine_top_k(*_vectors(data)).withColumn("score", F.round("score", 6))


@query
def d3_cosine_top_k_blocks(data: Inputs) -> DataFrame:
    return retrieval.cosine_top_k(*_vectors(data), block=4).withColumn("score", F.round("score", 6))


@query
def d4_approximate_top_k(data: Inputs) -> DataFrame:
    return retrieval.approximate_top_k(*_vectors(data)).withColumn("score", F.round("score", 6))


def _indexed(data: Inputs) -> tuple[DataFrame, VectorIndex]:
    """The queries, and an index of the store written by one step and searched by the next."""
    queries, store = _vectors(data)
    path = VectorIndex.build(store, data.path("vector-index")).path
    return queries, VectorIndex(data.spark, path)


@query
def d3_indexed_top_k(data: Inputs) -> DataFrame:
    queries, index = _indexed(data)
    return index.exact_top_k(queries).withColumn("score", F.round("score", 6))


@query
def d4_indexed_top_k(data: Inputs) -> DataFrame:
    queries, index = _indexed(data)
    return index.approximate_top_k(queries).withColumn("score", F.round("score", 6))


@query
def d5_store_count(data: Inputs) -> DataFrame:
    path = data.path("counted")
    stores.write_batch(data.chunks, path, 0, reset=True)
    return stores.read_store(data.spark, path, "id string").agg(F.count("*").alias("rows"))


@query
def d6_contexts(data: Inputs) -> DataFrame:
    return retrieval.contexts(data.hits, data.chunks).select("query_id", F.md5("context").alias("context_md5"))


@query
def d7_history_tails(data: Inputs) -> DataFrame:
    return retrieval.history_tails(data.table("conversations"))


@query
def d8_prompts(data: Inputs) -> DataFrame:
    context = retrieval.contexts(data.hits, data.chunks)
    return retrieval.prompts(data.table("conversations"), context)


@query
def d9_sources(data: Inputs) -> DataFrame:
    return retrieval.sources(data.hits, data.chunks)


# -- joins ---------------------------------------------------------------------------------


@query
def e1_resolved_names(data: Inputs) -> DataFrame:
    edges = data.corpus.raw_edges
    spelled = edges.select(F.explode(F.array(F.lower("source"), F.lower("target"))).alias("name")).distinct()
    return lineage.resolve_names(spelled, data.corpus.catalog)


@query
def e2_enriched_health(data: Inputs) -> DataFrame:
    return data.pipelines.select(
        "dag_id", "status", "last_run", F.round("duration_actual", 6).alias("duration_actual"),
        "duration_expected", "failure_count", "run_count", "last_error", "is_real", "schedule",
        F.array_join("tasks", ",").alias("tasks"), F.array_join("owners", ",").alias("owners"), "source_file",
    )


@query
def e3_health_sync(data: Inputs) -> DataFrame:
    done = health.observed_runs(data.view("run_log").where(F.col("status") != "running"))
    old = done.withColumn("duration_expected", F.lit(100.0)).withColumn("is_real", F.col("status") == "success")
    return health.sync_health(old, data.registry, data.view("run_log")).withColumn(
        "duration_actual", F.round("duration_actual", 6)
    )


@query
def e4_column_tags(data: Inputs) -> DataFrame:
    return catalog.column_tags(data.corpus.catalog).withColumn("pii_types", F.array_join("pii_types", "+"))


@query
def e5_neighbours(data: Inputs) -> DataFrame:
    return graph.neighbours(data.corpus.nodes, data.corpus.lineage)


@query
def e6_table_workflows(data: Inputs) -> DataFrame:
    return lineage.table_workflows(data.corpus.lineage, data.corpus.registry)


@query
def e7_workflow_owners(data: Inputs) -> DataFrame:
    owners = lineage.workflow_owners(data.registry)
    return data.health.select("dag_id", "status").join(owners, "dag_id", "left")


@query
def e8_catalog_lookup(data: Inputs) -> DataFrame:
    return catalog.lookup(data.corpus.catalog, "stg_0")


# -- aggregates ------------------------------------------------------------------------------


@query
def f1_observed_runs(data: Inputs) -> DataFrame:
    return health.observed_runs(data.view("run_log")).withColumn("duration_actual", F.round("duration_actual", 6))


@query
def f2_slo_summary(data: Inputs) -> DataFrame:
    return health.slo_summary(health.with_scores(data.health))


@query
def f3_critical_dags(data: Inputs) -> DataFrame:
    return health.critical(health.with_scores(data.health)).select("dag_id", "status", "slo_ok")


@query
def f4_null_profile(data: Inputs) -> DataFrame:
    return quality.null_profile(data.csv, CSV_COLUMNS)


@query
def f5_distinct_profile(data: Inputs) -> DataFrame:
    return quality.distinct_profile(data.csv, CSV_COLUMNS)


@query
def f6_f7_types(data: Inputs) -> DataFrame:
    return quality.type_profile(data.csv, CSV_COLUMNS)


@query
def f8_numeric_stats(data: Inputs) -> DataFrame:
    found = quality.profile(data.csv, CSV_COLUMNS)
    return found.where(F.col("numeric_stats").isNotNull()).select(
        "name", *(F.round(f"numeric_stats.{c}", 2).alias(c) for c in ("min", "max", "mean", "std", "median"))
    )


@query
def f8_lineitem_medians(data: Inputs) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    numbers = (
        data.table("lineitem").select(*columns).unpivot([], columns, "column", "number")
        .groupBy("column", "number").agg(F.count("*").alias("n"))
    )
    return quality.upper_medians(materialise(numbers, "numbers"))


@query
def f9_duplicate_rows(data: Inputs) -> DataFrame:
    return quality.duplicate_rows(data.csv, CSV_COLUMNS)


def _profiled(data: Inputs) -> tuple[DataFrame, DataFrame]:
    profiled = materialise(quality.profile(data.csv, CSV_COLUMNS), "profile")
    return profiled, quality.quality_summary(profiled, quality.duplicate_rows(data.csv, CSV_COLUMNS))


@query
def f10_quality_score(data: Inputs) -> DataFrame:
    return _profiled(data)[1]


@query
def f11_issues(data: Inputs) -> DataFrame:
    return quality.issues(*_profiled(data)).select("place", "severity", "message")


def _checks(data: Inputs) -> DataFrame:
    text = data.csv.select(*(F.when(has_text(F.col(c)), F.col(c)).alias(c) for c in CSV_COLUMNS))
    checks = [
        quality.quality_check(data.table("orders"), "orders", {"o_totalprice": "double", "o_orderpriority": "int"}),
        quality.quality_check(data.table("customer"), "customer"),
        quality.quality_check(text, "raw_csv", CSV_TYPES),
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query
def f12_quality_checks(data: Inputs) -> DataFrame:
    misfits = F.array_join(
        F.transform("schema_mismatches", lambda m: F.concat(m["column"], F.lit(":"), m["rows_affected"].cast("string"))), ","
    )
    return _checks(data).select(
        "table", "total_rows", "duplicate_rows", misfits.alias("misfits"), "quality_score", "passed"
    )


@query
def f13_check_totals(data: Inputs) -> DataFrame:
    return quality.null_shares(_checks(data)).withColumn("null_share", F.round("null_share", 6))


@query
def f14_catalog_stats(data: Inputs) -> DataFrame:
    return catalog.statistics(data.corpus.catalog)


@query
def f15_report_summary(data: Inputs) -> DataFrame:
    found = data.corpus
    return reports.summary(found.catalog, found.nodes, found.lineage, data.pipelines)


@query
def f16_pii_audit(data: Inputs) -> DataFrame:
    return catalog.pii_audit(data.corpus.catalog).withColumn("pii_types", F.array_join("pii_types", ", "))


@query
def f16_pii_totals(data: Inputs) -> DataFrame:
    return catalog.pii_totals(data.corpus.catalog)


@query
def f17_ingest_summary(data: Inputs) -> DataFrame:
    found = data.corpus
    return reports.ingest_summary(found.files, found.chunks, found.catalog, found.lineage, found.dags, found.skipped)


@query
def f18_graph_size(data: Inputs) -> DataFrame:
    return graph.graph_size(data.corpus.nodes, data.corpus.lineage)


@query
def f19_level_sizes(data: Inputs) -> DataFrame:
    return graph.level_sizes(data.corpus.levels)


@query
def f19_largest_level(data: Inputs) -> DataFrame:
    return graph.largest_level(data.corpus.levels)


# -- orders and firsts -----------------------------------------------------------------------


@query
def g1_merged_definitions(data: Inputs) -> DataFrame:
    return data.corpus.catalog.select(
        "name", F.array_join("columns", ",").alias("columns"), "source_file",
        F.col("ordinal.file_ord").alias("file_ord"), F.col("ordinal.text_ord").alias("text_ord"),
        F.col("ordinal.block_ord").alias("block_ord"),
    )


@query
def g2_merged_edges(data: Inputs) -> DataFrame:
    return data.corpus.lineage


@query
def g3_last_registry_rows(data: Inputs) -> DataFrame:
    return data.corpus.registry.select(
        "dag_id", "source_file", F.array_join("tasks", ",").alias("tasks"), F.array_join("owners", ",").alias("owners")
    )


@query
def g4_recent_checks(data: Inputs) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return (
        data.table("events").withColumn("place", F.row_number().over(newest)).where(F.col("place") <= 10)
        .select("user_id", "place", "event_id", "value")
    )


@query
def g5_ordered_listing(data: Inputs) -> DataFrame:
    return data.pipelines.select("dag_id", "status", "run_count").orderBy("dag_id")


# -- sets and graph ----------------------------------------------------------------------------


@query
def h1_node_set(data: Inputs) -> DataFrame:
    return data.corpus.nodes.orderBy("id")


@query
def h2_corpus_union(data: Inputs) -> DataFrame:
    found = data.corpus
    parts = {
        "edge": found.raw_edges.select(F.col("file").alias("path")),
        "definition": found.definitions.select("path"),
        "dag": found.dags.select(F.col("source_file").alias("path")),
        "chunk": found.chunks.select(F.col("file").alias("path")),
    }
    rows = [df.withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    merged = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return merged.groupBy("path", "kind").agg(F.count("*").alias("found"))


@query
def h3_node_roles(data: Inputs) -> DataFrame:
    return graph.node_roles(data.corpus.nodes, data.corpus.lineage).select("id", "role")


@query
def h4_levels(data: Inputs) -> DataFrame:
    degrees = graph.node_roles(data.corpus.nodes, data.corpus.lineage).select("id", "in_degree")
    return data.corpus.levels.join(degrees, "id")


@query
def h5_upstream(data: Inputs) -> DataFrame:
    edges = data.corpus.lineage
    start = edges.where(F.col("target") == "rpt_30").select(F.col("target").alias("id"))
    return graph.reach(edges, start, "upstream")


@query
def h5_downstream(data: Inputs) -> DataFrame:
    edges = data.corpus.lineage
    start = edges.where(F.col("source") == "raw_hub").select(F.col("source").alias("id"))
    return graph.reach(edges, start, "downstream")


@query
def h5_dependent_pairs(data: Inputs) -> DataFrame:
    """Of every edge: backwards, to one report, and from the hub, which of them depend on each other."""
    edges = data.corpus.lineage.select("source", "target")
    asked = (
        edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
        .unionByName(edges.select("source", F.lit("rpt_30").alias("target")))
        .unionByName(edges.select(F.lit("raw_hub").alias("source"), "target"))
        .distinct()
    )
    return graph.Reachability.build(data.corpus.nodes, edges).depends(asked)


@query
def h6_failing(data: Inputs) -> DataFrame:
    return health.failing(health.with_scores(data.health))


@query
def h6_failing_on_day(data: Inputs) -> DataFrame:
    last_day = data.view("run_log").agg(F.to_date(F.max("ts"))).scalar()
    return health.failing(health.with_scores(data.health), last_day)


# -- whole runs ----------------------------------------------------------------------------


def _loaded(data: Inputs, files: DataFrame) -> tuple[flows.Warehouse, DataFrame]:
    """Files written as a tree and loaded from there, as a user does."""
    tree, root = data.path("flow-tree"), data.path("flow-tables")
    write_code_tree(files, tree)
    counts = flows.load_tree(data.spark, tree, root, "first", data.view("run_log"), VECTOR_DIM)
    return flows.Warehouse(data.spark, root), counts


@query
def flow_load_tree(data: Inputs) -> DataFrame:
    tables, _ = _loaded(data, data.view("code_files"))
    return tables.catalog.select(
        "name", F.size("columns").alias("n_columns"), F.size("pii_columns").alias("n_pii"), F.col("created_at").isNotNull().alias("dated")
    )


@query
def flow_profile_file(data: Inputs) -> DataFrame:
    folder = data.path("flow-profile") + ".csv"
    data.csv.drop("row_id").write.csv(folder, header=True, emptyValue="")
    found = flows.profile_file(data.spark, folder).summary
    return found.withColumns({"filename": F.col("filename").endswith(".csv"), "analyzed_at": F.col("analyzed_at").isNotNull()})


@query
def flow_ask(data: Inputs) -> DataFrame:
    tables, _ = _loaded(data, data.view("text_files"))
    return flows.ask(tables, data.table("conversations"))[0]


# -- named actions as table functions ------------------------------------------------------


def _functions(data: Inputs) -> None:
    actions.register_views(data.corpus.catalog, data.corpus.lineage, data.pipelines)
    actions.register_functions(data.spark)


@query
def actions_get_lineage(data: Inputs) -> DataFrame:
    _functions(data)
    return data.spark.sql("SELECT source, target, transformation, file FROM get_lineage()")


@query
def actions_get_health(data: Inputs) -> DataFrame:
    _functions(data)
    return data.spark.sql("SELECT dag_id, status, slo_ok FROM get_health() WHERE NOT slo_ok")


@query
def actions_get_tables(data: Inputs) -> DataFrame:
    _functions(data)
    return data.spark.sql("SELECT name, size(columns) AS n_columns FROM get_tables()")


# -- streams -----------------------------------------------------------------------------------


def _streamed(data: Inputs, name: str, per_key: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    events = incremental.read_files_as_stream(data.spark, f"{data.sf_dir}/{name}.parquet")
    updates = per_key(events)
    path = data.path(f"stream-{name}")
    incremental.keep_table(updates, path, data.path("stream-state"), key).awaitTermination()
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in updates.schema.fields)
    return stores.read_store(data.spark, path, fields, key)


@query
def f1_watermarked_runs(data: Inputs) -> DataFrame:
    """The run log as it comes in: three parts by time, every 50th run a part late, a trigger for each."""
    runs = data.view("run_log").select("dag_id", "run_id", "ts", "status")
    micros, every = F.unix_micros("ts"), runs.agg(F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last")).first()
    third = max(1, (every["last"] - every["first"]) // 3 + 1) if every["first"] is not None else 1
    part = F.floor((micros - F.lit(every["first"])) / third) + F.when(F.col("run_id") % 50 == 0, 1).otherwise(0)
    arriving, out, state = data.path("runs-arriving"), data.path("run-windows"), data.path("stream-state")
    schema = "dag_id string, run_id bigint, ts timestamp, status string"
    for number in range(4):
        runs.where(part == number).write.mode("append").parquet(arriving)
        stream = data.spark.readStream.schema(schema).parquet(arriving)
        incremental.append_windows(stream, out, state, "36 hours").awaitTermination()
    return data.spark.read.schema("since timestamp, dag_id string, run_count long, failure_count long").parquet(out)


@query
def k1_stream_throughput(data: Inputs) -> DataFrame:
    return _streamed(data, "events", lambda e: incremental.throughput(e, "user_id"), "user_id")


@query
def k1_batch_throughput(data: Inputs) -> DataFrame:
    return incremental.throughput(data.table("events"), "event_type")


@query
def k2_stream_progress(data: Inputs) -> DataFrame:
    return _streamed(data, "events", lambda e: incremental.latest_progress(progress_snapshots(e)), "run_id")


@query
def k2_closing_progress(data: Inputs) -> DataFrame:
    """As a stream whose state ends once a run is done."""
    return _streamed(data, "events", lambda e: incremental.closing_progress(progress_snapshots(e), "40 days"), "run_id")


@query
def k2_batch_progress(data: Inputs) -> DataFrame:
    return incremental.latest_progress(data.snapshots)


@query
def k3_stream_chunks(data: Inputs) -> DataFrame:
    documents = incremental.read_files_as_stream(data.spark, f"{data.sf_dir}/documents.parquet")
    files = documents.select(
        F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("content"),
    )
    path = data.path("stream-chunks")
    incremental.ingest_chunks(files, path, data.path("stream-state")).awaitTermination()
    schema = schemas.CHUNK_VECTORS.replace(", embedding array<float>", "")
    return stores.read_store(data.spark, path, schema).select("id", "file", "chunk", F.md5("text").alias("text_md5"))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Inputs(spark, sf_dir))
