"""Files and tables in and out."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators import quality, reports
from tidemark.plans.actions import register_functions, register_views, run_action
from tidemark.plans.corpus import Corpus
from tidemark.sources import code_tree, stores
from tidemark.sources.code_tree import read_code_tree, write_code_tree
from tidemark.sources.delimited import read_delimited


def test_code_tree(spark, tmp_path):
    files = {
        "a.py": b"x = 1\r\ny = 2", "pkg/__init__.py": b"z = 1", ".github/w.yml": b"on: push", "UP.SQL": b"SELECT 1",
        "bad.md": b"ok \xff\xfe done", "blank.txt": b" \n\t", "empty.txt": b"", "no.csv": b"1,2", "node_modules/x.py": b"q",
        "deep/build/y.py": b"q", "deep/er/z.yaml": "é".encode(), "build.py": b"b", ".sql": b"s",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = {r["path"]: r["content"] for r in read_code_tree(spark, str(tmp_path)).collect()}
    assert found == {
        "a.py": "x = 1\ny = 2", "pkg/__init__.py": "z = 1", ".github/w.yml": "on: push", "UP.SQL": "SELECT 1",
        "bad.md": "ok  done", "deep/er/z.yaml": "é", "build.py": "b",
    }
    corpus = Corpus(read_code_tree(spark, f"file://{tmp_path}"))
    assert corpus.files.count() == 7 and corpus.chunks.count() == 7


def test_a_tree_is_listed_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(code_tree, "LISTED_FOLDERS", 3)
    monkeypatch.setattr(code_tree, "TASK_BYTES", 20 * code_tree.OPEN_BYTES)
    for i in range(120):
        (tmp_path / f"a{i % 7}" / f"b{i % 11}" / "c").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"a{i % 7}" / f"b{i % 11}" / "c" / f"f{i}.sql").write_text("x" * i + "y")
    bare = str(tmp_path)  # as Spark resolves it
    assert code_tree.qualified(spark, bare) == f"file:{bare}" == code_tree.qualified(spark, f"file://{bare}")
    listed = {r["path"]: r["size"] for r in code_tree.list_code_tree(spark, bare).collect()}
    assert listed == {str(p): p.stat().st_size for p in tmp_path.rglob("*.sql")}
    rows = read_code_tree(spark, bare)
    assert rows.rdd.getNumPartitions() == 7 and rows.count() == 120
    (tmp_path / "empty").mkdir()
    assert read_code_tree(spark, str(tmp_path / "empty")).count() == 0


def test_code_tree_round_trip(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}.py", f"v = {i}\n") for i in range(20)]
    write_code_tree(spark.createDataFrame(rows, "path string, content string"), str(tmp_path))
    assert sorted(map(tuple, read_code_tree(spark, str(tmp_path)).select("path", "content").collect())) == sorted(rows)


@pytest.mark.parametrize(
    "text, head, rows",
    [
        (
            'a,b,c\n1,"x, y",3\n\n  \n4,5\n6,7,8,9\n"open,1,2\n', ["a", "b", "c"],
            [("1", "x, y", "3"), ("4", "5", ""), ("6", "7", "8"), ("open,1,2", "", "")],
        ),
        ('a;b\n1;2,5\n"q;r"";s";3', ["a", "b"], [("1", "2,5"), ("q;r;s", "3")]),
        ("a,b;c\r\n1,2\r\n3,4\r\n", ["a", "b;c"], [("1", "2"), ("3", "4")]),
        ('say ""hi"",b\n a"b"c , " d " \n', ["say hi", "b"], [("abc", "d")]),
        ("a,b\n1\x0b2\x0c3,4 \x855,6", ["a", "b"], [("1", ""), ("2", ""), ("3", "4"), ("5", "6")]),
        ("only\nx\ny", ["only"], [("x",), ("y",)]),
    ],
)
def test_delimited(spark, tmp_path, text, head, rows):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    found = read_delimited(spark, str(path))
    assert found.columns[1:] == head
    assert [tuple(r)[1:] for r in found.orderBy("row_id").collect()] == rows


def test_delimited_encodings_and_errors(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes("näme,b\né,1\n".encode("latin-1"))
    assert read_delimited(spark, str(path)).select("näme").first()[0] == "é"
    (tmp_path / "e.csv").write_bytes(b"")
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "e.csv"))
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "e.txt"))


def test_odd_headers(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("a,A,,row_id,x.y,b`c,a_2\n1,2,3,4,5,6,7\n")
    table = read_delimited(spark, str(path))
    assert table.columns == ["row_id", "a", "A_2", "_c2", "row_id_2", "x.y", "b`c", "a_2_2"]
    found = quality.profile(table, table.columns[1:]).orderBy("pos").collect()
    assert [(r["name"], r["numeric_stats"]["median"]) for r in found] == list(zip(table.columns[1:], range(1, 8)))
    assert quality.duplicate_rows(table, table.columns[1:]).first()[:] == (1, 0)
    assert quality.preview(table, "row_id").first()["row"]["b`c"] == "6"
    plain = table.drop("row_id")
    assert quality.quality_check(plain, "t", {"b`c": "int", "x.y": "date"}).first()["total_rows"] == 1


def test_large_delimited_file_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("id,v\n" + "".join(f"{i},{'x' * 50}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = read_delimited(spark, str(path))
        assert found.rdd.getNumPartitions() > 4
        assert found.select(F.count("*"), F.sum(F.col("id").cast("long"))).first()[:] == (20_000, sum(range(20_000)))
        assert [r["id"] for r in found.orderBy("row_id").limit(3).collect()] == ["0", "1", "2"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_with_their_own_headers(spark, tmp_path):
    """Columns in another order, another delimiter, another encoding: each file by its own header."""
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("id,amount\n1,10\n")
    (folder / "b.csv").write_text("amount,id\n30,3\n\n40,4,5\n")
    (folder / "c.csv").write_text('id;amount\n5;"50;5"\n6\n')
    (folder / "d.csv").write_bytes("amount,id\nsechzig \xe9,7\nsiebzig é,8\n".encode("latin-1"))
    found = read_delimited(spark, str(folder))
    assert found.columns == ["row_id", "id", "amount"]
    assert sorted(tuple(r)[1:] for r in found.collect()) == [
        ("1", "10"), ("3", "30"), ("4", "40"), ("5", "50;5"), ("6", ""), ("7", "sechzig é"), ("8", "siebzig é"),
    ]
    (folder / "e.csv").write_text("id,other\n1,2\n")
    with pytest.raises(ValueError, match="columns differ"):
        read_delimited(spark, str(folder))


def test_refreshes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda n: spark.range(n).withColumnRenamed("id", "a")
    read = lambda: stores.read_table(spark, path, "a long")
    assert read().count() == 0
    stores.full_refresh(rows(5), path)
    stores.full_refresh(read().where("a > 2"), path)  # made from the old rows
    assert read().count() == 2
    assert not stores.guarded_refresh(rows(0), path)
    assert read().count() == 2
    assert stores.guarded_refresh(rows(3), path)
    assert read().count() == 3
    stores.full_refresh(rows(0), path)
    assert read().count() == 0


def test_a_refresh_that_is_cut_off_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    stores.full_refresh(spark.range(4), path)
    fails = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        stores.full_refresh(fails, path)
    (tmp_path / "t" / "version=1").mkdir(exist_ok=True)  # files of a job that never ended
    spark.range(2).coalesce(1).write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/version=1")
    assert stores.read_table(spark, path, "id long").count() == 4
    stores.full_refresh(spark.range(7), path)
    assert stores.read_table(spark, path, "id long").count() == 7


def test_store_batches(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "id string, text string"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    read = lambda p=path: {r["id"]: r["text"] for r in stores.read_store(spark, p, schema).collect()}
    assert read() == {}
    stores.write_batch(rows(("a", "1"), ("b", "1")), path, 0, reset=True)
    assert "Exchange" not in stores.read_store(spark, path, schema)._jdf.queryExecution().toString()
    stores.write_batch(rows(("b", "2"), ("c", "2")), path, 1)
    stores.write_batch(rows(("b", "2"), ("c", "2")), path, 1)  # once more after a failure
    stores.write_batch(rows(("c", "3")), path, 2)
    assert read() == {"a": "1", "b": "2", "c": "3"}
    stores.compact(spark, path, schema, str(tmp_path / "c"))
    assert read(str(tmp_path / "c")) == read()
    stores.write_batch(rows(("z", "0")), path, 0, reset=True)
    assert read() == {"z": "0"}


def test_batches_that_never_finished_do_not_show(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "id string, text string"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    read = lambda: {r["id"]: r["text"] for r in stores.read_store(spark, path, schema).collect()}
    for done, written in enumerate(("1", "2")):
        rows(("z", "cut off")).write.parquet(f"{path}/batch={done + 7}/version=0")  # a job without its mark
        (tmp_path / "s" / f"batch={done + 7}" / "version=0" / "_SUCCESS").unlink()
        stores.write_batch(rows(("a", written)), path, done)
        assert read() == {"a": written}
    rows(("a", "cut off")).write.parquet(f"{path}/batch=1/version=1")  # the same batch once more, cut off
    (tmp_path / "s" / "batch=1" / "version=1" / "_SUCCESS").unlink()
    assert read() == {"a": "2"}
    stores.write_batch(rows(("a", "3")), path, 1)
    assert read() == {"a": "3"}


def test_a_key_twice_in_a_batch_is_stored_once(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "id string, at int, text string"
    batch = spark.createDataFrame([("a", 2, "late"), ("b", 1, "only"), ("a", 1, "soon"), ("a", 2, "late")], schema)
    stores.write_batch(batch, path, 0, order=["at"])
    assert sorted(map(tuple, stores.read_store(spark, path, schema).collect())) == [("a", 2, "late"), ("b", 1, "only")]


def test_reports(spark, data, tmp_path):
    found = data.corpus
    totals = reports.summary(found.catalog, found.nodes, found.lineage, data.pipelines)
    sections = reports.csv_sections(found.catalog, found.lineage, data.pipelines, totals)
    reports.write_csv(sections, str(tmp_path))
    shown = {r["Metric"]: r["Value"] for r in spark.read.csv(str(tmp_path / "summary"), header=True).collect()}
    assert shown["Total Tables"] == str(found.catalog.count()) and shown["SLO %"].endswith("%")
    assert list(sections) == ["summary", "data_catalog", "pii_audit", "data_lineage", "pipeline_health"]
    errors = spark.read.csv(str(tmp_path / "pipeline_health"), header=True, escape='"').select("DAG ID", "Last Error")
    wanted = data.pipelines.select("dag_id", F.coalesce(F.nullif("last_error", F.lit("")), F.lit(None)))
    assert sorted(map(tuple, errors.na.fill("").collect())) == sorted(map(tuple, wanted.na.fill("").collect()))


def test_actions(spark, data):
    register_views(data.corpus.catalog, data.corpus.lineage, data.pipelines)
    assert run_action(spark, "get_tables").count() == data.corpus.catalog.count()
    assert run_action(spark, "get_lineage").columns == ["source", "target", "transformation", "file"]
    assert run_action(spark, "get_health").count() == data.pipelines.count()
    checked = run_action(spark, "trigger_quality_check", table_name="lineage").first()
    assert checked["total_rows"] == data.corpus.lineage.count() and checked["duplicate_rows"] == 0
    with pytest.raises(KeyError):
        run_action(spark, "drop_tables")


def test_actions_as_table_functions(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    register_views(rows("t"), rows("e"), rows("p"))
    register_functions(spark)
    for name, want in (("get_tables", "t"), ("get_lineage", "e"), ("get_health", "p")):
        assert [r["id"] for r in spark.sql(f"SELECT * FROM {name}()").collect()] == [want]
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM get_nothing()").collect()


def test_files_are_read_many_to_a_batch(tmp_path):
    """Small files share a batch, long ones do not pile up, and none is lost."""
    from tidemark.sources import code_tree

    for i in range(2_500):
        (tmp_path / f"f{i}.py").write_text(f"x = {i}")
    for i in range(3):
        (tmp_path / f"long{i}.sql").write_text("y" * 3_000_000)
    (tmp_path / "blank.py").write_text(" \n")
    paths = sorted(str(p) for p in tmp_path.iterdir())
    asked = code_tree.pa.record_batch({"path": paths})
    parts = list(code_tree._read(f"file://{tmp_path}")([asked]))
    assert len(parts) <= 6 and max(p.num_rows for p in parts) <= 1_000 and max(p.nbytes for p in parts) < 10_000_000
    found = {r["path"]: r["content"] for p in parts for r in p.to_pylist()}
    assert found == {p.rsplit("/", 1)[1]: open(p).read() for p in paths if not p.endswith("blank.py")}
