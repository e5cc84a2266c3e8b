"""Mining rules on small texts, and on texts put together from known parts."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import catalog, lineage, mining
from tidemark.plans.corpus import Corpus


def files(spark, *contents, path="sql/f{}.sql"):
    rows = [(i, path.format(i), c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "file_ord long, path string, content string")


def columns_of(spark, body):
    texts = mining.sql_texts(files(spark, f"CREATE TABLE some_name ({body})"))
    found = mining.tag_pii(mining.table_definitions(mining.create_table_blocks(texts))).first()
    return found["columns"], [(p["column"], p["pii_types"]) for p in found["pii_columns"]]


@pytest.mark.parametrize(
    "body, expected",
    [
        ("id INT, name TEXT", ["id", "name"]),
        ("id INT, PRIMARY KEY (id), CHECK (id > 0)", ["id"]),
        ("created_at TIMESTAMP, time INT, event TEXT, ok INT", ["ok"]),
        ('"created_at" TIMESTAMP, `time` INT, [event] TEXT', ["created_at", "time", "event"]),
        ("key_id INT, check_date DATE, index_no INT, val INT", ["val"]),
        ("amount DECIMAL(10,2), f(x,y) INT, z INT", ["amount", "f(x,y)", "z"]),
        ("-- comment, a INT, /* b */, c INT", ["a", "c"]),
        ("1x INT, _y INT, \n\t z\tTEXT", ["_y", "z"]),
        ("", []),
    ],
)
def test_columns(spark, body, expected):
    assert columns_of(spark, body)[0] == expected


def test_pii_columns(spark):
    found = columns_of(spark, "user_email TEXT, birthdate DATE, plain INT")[1]
    assert found == [("user_email", ["email"]), ("birthdate", ["birth", "birthdate"])]


def blocks_of(spark, sql):
    rows = mining.create_table_blocks(mining.sql_texts(files(spark, sql))).orderBy("block_ord").collect()
    return [(r["name"], r["body"]) for r in rows]


def test_blocks(spark):
    sql = """create or replace temporary table if not exists dw.t_one (a INT, b NUMERIC(1,(2)))
    CREATE TABLE "t_two" (x INT) CREATE TABLE [t_three](y INT) CREATE TABLE `t_four` (z INT)
    CREATE TABLE t_five AS SELECT 1  CREATE TABLE select (q INT) CREATE TABLE t_six (open INT"""
    assert blocks_of(spark, sql) == [
        ("t_one", "a INT, b NUMERIC(1,(2))"), ("t_two", "x INT"), ("t_three", "y INT"), ("t_four", "z INT"),
    ]


def test_block_inside_a_block_is_found_too(spark):
    found = blocks_of(spark, "CREATE TABLE outer_t (a INT, CREATE TABLE inner_t (b INT), c INT)")
    assert [n for n, _ in found] == ["outer_t", "inner_t"]
    assert found[1][1] == "b INT"


def test_stray_closings_do_not_matter(spark):
    assert blocks_of(spark, ") ) CREATE TABLE t_a (x INT) ) (") == [("t_a", "x INT")]


def edges_of(spark, sql, path="sql/f{}.sql"):
    found = mining.raw_edges(files(spark, sql, path=path)).orderBy(*mining.EDGE_ORDER).collect()
    return [(r["source"], r["target"], r["transformation"]) for r in found]


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("INSERT INTO dw.tgt SELECT * FROM raw.src;", [("src", "tgt", "INSERT_SELECT")]),
        ("insert or ignore into tgt select * from s1 a join db.s2 b on 1=1",
         [("s1", "tgt", "INSERT_SELECT"), ("s2", "tgt", "JOIN")]),
        # A later JOIN of the same name, or of it as a schema, labels every mention.
        ("INSERT INTO tgt SELECT * FROM s1 JOIN s1", [("s1", "tgt", "JOIN"), ("s1", "tgt", "JOIN")]),
        ("INSERT INTO tgt SELECT * FROM db JOIN db.s2", [("db", "tgt", "JOIN"), ("s2", "tgt", "JOIN")]),
        # Only up to the first semicolon after SELECT.
        ("INSERT INTO tgt SELECT * FROM s1; DELETE FROM s2", [("s1", "tgt", "INSERT_SELECT")]),
        # Without SELECT the whole rest counts.
        ("INSERT INTO tgt VALUES (1); DELETE FROM s2", [("s2", "tgt", "INSERT_SELECT")]),
        ("INSERT INTO Tgt SELECT * FROM tGT", []),
        ("INSERT INTO tgt SELECT * FROM select", []),
        ("INSERT INTO x SELECT * FROM s1", []),
        ("INSERT INTO t_a SELECT 1 FROM s1 INSERT INTO t_b SELECT 1 FROM s2",
         [("s1", "t_a", "INSERT_SELECT"), ("s2", "t_b", "INSERT_SELECT")]),
        # FROM needs no word border before it, JOIN does for the label.
        ("INSERT INTO tgt SELECT 1 xFROM s1 LEFT_JOIN s2", [("s1", "tgt", "INSERT_SELECT"), ("s2", "tgt", "INSERT_SELECT")]),
        ("INSERT INTO tgt SELECT * FROM naïve", []),
    ],
)
def test_insert_edges(spark, sql, expected):
    assert edges_of(spark, sql) == expected


@pytest.mark.parametrize(
    "code, expected",
    [
        ('my_tab_table_insert = """SELECT 1 FROM s1"""', [("s1", "my_tab", "INSERT_SELECT")]),
        ('Orders_LOAD = ("""SELECT 1 FROM (db.s1)""")', [("s1", "orders", "INSERT_SELECT")]),
        ("user_upsert = '''select 1 from s1 a join s2 b'''", [("s1", "user", "INSERT_SELECT"), ("s2", "user", "JOIN")]),
        # The alias pattern swallows the word after a bare name, here the JOIN.
        ("user_upsert = '''select 1 from s1 join s2'''", [("s1", "user", "INSERT_SELECT")]),
        ('x_table = """SELECT 1 FROM s1"""', []),
        ('s1_insert = """SELECT 1 FROM S1"""', []),
        ('a_insert_x = """SELECT 1 FROM s1"""', [("s1", "a_insert_x", "INSERT_SELECT")]),
        ('t_insert = """DELETE FROM s1"""', []),
        ('event_insert = """SELECT 1 FROM s1"""', []),
    ],
)
def test_variable_edges(spark, code, expected):
    assert edges_of(spark, code, path="dags/f{}.py") == expected


def test_python_files_use_quoted_sql_only(spark):
    code = '# INSERT INTO t_a SELECT 1 FROM s1\nq = """INSERT INTO t_b SELECT 1 FROM s2"""\nd = """plain"""'
    assert edges_of(spark, code, path="f{}.py") == [("s2", "t_b", "INSERT_SELECT")]


def test_very_long_texts(spark):
    blob = "A" * 1_000_000
    code = f'x_insert = "{blob}"\ny = {" " * 100_000}1\nt_insert = """SELECT 1 FROM s1"""\n' + "(" * 200_000
    assert edges_of(spark, code, path="f{}.py") == [("s1", "t", "INSERT_SELECT")]
    sql = "CREATE TABLE t_big (" + ", ".join(f"c_{i} DECIMAL(1,2)" for i in range(30_000)) + ")"
    assert len(columns_of(spark, sql[20:-1])[0]) == 30_000


# -- random texts against plain restatements ---------------------------------------------------


def test_insert_texts_of_known_edges(spark):
    """Statements are put together from a target and its sources, in any spelling."""
    rng = random.Random(5)
    tables = ["aa", "bb", "Cc", "dd_1", "e2"]
    either = lambda word: rng.choice([word, word.lower(), word.capitalize()])
    gap = lambda: rng.choice([" ", "  ", "\n", " \n "])
    name = lambda table: rng.choice(["", "db."]) + table
    texts, expected = [], {}
    for number in range(400):
        parts, edges = [], []
        for _ in range(rng.randint(1, 3)):
            target, *sources = rng.sample(tables, rng.randint(2, 4))
            head = [either("INSERT"), *rng.choice([[], ["OR", "REPLACE"]]), either("INTO"), name(target), rng.choice(["", "(x, y)"])]
            body = [either("SELECT"), "x", either("FROM"), name(sources[0])]
            for other in sources[1:]:
                body += [rng.choice(["", "LEFT"]), either("JOIN"), name(other), "ON", "1 = 1"]
            parts.append(gap().join([*head, *body]) + rng.choice([";", " ; "]) + rng.choice(["", "SELECT 1 FROM zz;", "x"]))
            edges += [(s, target, "INSERT_SELECT" if s == sources[0] else "JOIN") for s in sources]
        texts.append("\n".join(parts))
        expected[number] = edges
    rows = mining.insert_edges(mining.sql_texts(files(spark, *texts))).orderBy(*mining.EDGE_ORDER).collect()
    found = {}
    for r in rows:
        found.setdefault(r["file_ord"], []).append((r["source"], r["target"], r["transformation"]))
    assert found == expected


@pytest.mark.parametrize(
    "text, edges",
    [
        ("INSERT INTO aa SELECT 1 FROM aa", []),  # its own source
        ("INSERT INTO aa SELECT 1 FROM select", []),  # a keyword
        ("INSERT INTO x SELECT 1 FROM bb", []),  # too short a target
        ("INSERT INTO aa VALUES (1); SELECT 1 FROM bb", [("bb", "aa", "INSERT_SELECT")]),  # the next SELECT counts
        ("INSERT INTO aa SELECT 1 FROM bb; JOIN cc", [("bb", "aa", "INSERT_SELECT")]),
        ("INSERT INTO aa SELECT 1 FROM bb JOIN bb", [("bb", "aa", "JOIN"), ("bb", "aa", "JOIN")]),
    ],
)
def test_insert_rules(spark, text, edges):
    rows = mining.insert_edges(mining.sql_texts(files(spark, text))).orderBy(*mining.EDGE_ORDER).collect()
    assert [(r["source"], r["target"], r["transformation"]) for r in rows] == edges


def test_random_bodies(spark):
    rng = random.Random(6)
    bits = ["a INT", "b(1,2)", ",", ",", "(", ")", "PRIMARY KEY", "'", "key_x", '"time"', "time", " ", "c_1 DECIMAL(3, (1))"]
    texts = ["CREATE TABLE tt (" + "".join(rng.choice(bits) for _ in range(rng.randint(1, 15))) + ")" for _ in range(500)]

    def plain(sql):
        depth, start, item, items = 1, sql.index("(") + 1, "", []
        for i in range(start, len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if depth == 0:
                return [x.strip() for x in [*items, item]]
            if sql[i] == "," and depth == 1:
                items, item = [*items, item], ""
            else:
                item += sql[i]
        return None

    rows = mining.create_table_blocks(mining.sql_texts(files(spark, *texts))).where("block_ord = 0").collect()
    found = {r["file_ord"]: [x.strip() for x in r["items"]] for r in rows}
    assert found == {i: plain(t) for i, t in enumerate(texts) if plain(t) is not None}


# -- merging -------------------------------------------------------------------------------------


def test_widest_definition_wins(spark):
    found = Corpus(
        files(
            spark,
            "CREATE TABLE t_empty () CREATE TABLE t_late (PRIMARY KEY (a))",
            "CREATE TABLE t_x (a INT) CREATE TABLE t_x (b INT, c INT)",  # last in the file counts
            "CREATE TABLE t_x (d INT, e INT)",  # as wide: the earlier stays
            "CREATE TABLE T_X (f INT)",  # names differ by case
            "CREATE TABLE t_late (a INT)",
            "CREATE TABLE t_x (g INT, h INT, i INT)",
        )
    ).catalog
    rows = {r["name"]: (r["columns"], r["source_file"], r["ordinal"]["file_ord"]) for r in found.collect()}
    assert rows == {
        "t_x": (["g", "h", "i"], "sql/f5.sql", 1),
        "T_X": (["f"], "sql/f3.sql", 3),
        "t_late": (["a"], "sql/f4.sql", 4),
    }


RESOLVED = """
SELECT w.name, coalesce(
         min_by(k.name, k.place) FILTER (lower(k.name) IN (w.name, w.name || 's', w.name || 'es')),
         min_by(k.name, k.place) FILTER (starts_with(lower(k.name), w.name))) AS resolved
FROM wanted w, known k GROUP BY w.name
"""


def test_random_names_resolve_like_sql(spark):
    rng = random.Random(8)
    known = list(dict.fromkeys("".join(rng.choice("aAbes_") for _ in range(rng.randint(2, 6))) for _ in range(400)))
    wanted = list({"".join(rng.choice("abes_") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    known.append("long_" * 30)
    wanted += ["long_" * 15, "long_" * 31]
    entries = spark.createDataFrame([(n, i) for i, n in enumerate(known)], "name string, place long").select(
        "name", F.struct(F.col("place").alias("file_ord")).alias("ordinal")
    )
    asked = spark.createDataFrame([(n,) for n in wanted], "name string")
    found = {r["name"]: r["resolved"] for r in lineage.resolve_names(asked, entries).collect()}
    connection = duckdb.connect()
    connection.execute("CREATE TABLE known (name VARCHAR, place BIGINT)")
    connection.executemany("INSERT INTO known VALUES (?, ?)", [(n, i) for i, n in enumerate(known)])
    connection.execute("CREATE TABLE wanted (name VARCHAR)")
    connection.executemany("INSERT INTO wanted VALUES (?)", [(n,) for n in wanted])
    assert found == {n: c for n, c in connection.execute(RESOLVED).fetchall() if c}
    assert found["long_" * 15] == "long_" * 30


def test_first_edge_per_pair_wins(spark):
    found = Corpus(
        files(
            spark,
            "CREATE TABLE orders (a INT); CREATE TABLE boxes (b INT); CREATE TABLE cust_daily (c INT)",
            "INSERT INTO tgt SELECT 1 FROM Order JOIN box",  # Order is a keyword
            "INSERT INTO tgt SELECT 1 FROM box; ",
            "INSERT INTO TGT SELECT 1 FROM BOXES JOIN cust",
            "INSERT INTO orders SELECT 1 FROM orders_x JOIN cust_d",
            "INSERT INTO cust SELECT 1 FROM cust_daily",
        )
    ).lineage
    rows = sorted((r["source"], r["target"], r["transformation"], r["file"]) for r in found.collect())
    assert rows == [
        ("boxes", "tgt", "JOIN", "sql/f1.sql"),
        ("cust_daily", "TGT", "JOIN", "sql/f3.sql"),
        ("cust_daily", "orders", "JOIN", "sql/f4.sql"),
        ("orders_x", "orders", "INSERT_SELECT", "sql/f4.sql"),
    ]


def test_hot_name_keeps_every_edge(spark):
    """One source feeds a third of all targets; nothing is lost or doubled."""
    edges = spark.range(3000).select(
        F.col("id").alias("file_ord"), F.lit(0).alias("part"), F.lit(0).alias("text_ord"), F.lit(0).alias("block_ord"),
        F.lit(0).alias("src_ord"),
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("src_"), "id")).alias("source"),
        F.concat(F.lit("tgt_"), F.col("id").cast("string")).alias("target"),
        F.lit("JOIN").alias("transformation"), F.lit("f").alias("file"),
    )
    known = spark.createDataFrame([("hubs", 0)], "name string, p long").select("name", F.struct("p").alias("ordinal"))
    found = lineage.merge_edges(edges, known)
    assert found.count() == 3000
    assert found.where("source = 'hubs'").count() == 1000


# -- labels and searches --------------------------------------------------------------------------


def test_path_rules(spark):
    rows = [("a.py", True), ("x/A.SQL", True), ("build/a.py", False), ("a/.git/b.md", False), ("a/build", False),
            (".sql", False), ("a/.sql", False), ("rebuild/a.yml", True), ("a.csv", False), ("x/.env.yaml", True)]
    found = spark.createDataFrame(rows, "path string, ok boolean").select(names.is_code_path(F.col("path")) == F.col("ok"))
    assert all(r[0] for r in found.collect())


def test_labels(spark):
    paths = ["a.py", "a.sql", "a.yml", "a.yaml", "a.md", "a.SQL", "a"]
    found = spark.createDataFrame([(p,) for p in paths], "p string").select(names.file_type(F.col("p"))).collect()
    assert [r[0] for r in found] == ["python", "sql", "yaml", "yaml", "markdown", "text", "text"]
    base = spark.createDataFrame([("a/b.c",), ("b",), ("a/",), (None,)], "p string").select(names.basename(F.col("p")))
    assert [r[0] for r in base.collect()] == ["b.c", "b", "—", "—"]


def test_search_and_lookup(spark):
    found = Corpus(files(spark, "CREATE TABLE Users (email INT, a INT, b INT, c INT, d INT, ee INT, f INT)",
                         "CREATE TABLE plain (zip INT)")).catalog
    assert [r["name"] for r in catalog.search(found, "USER").collect()] == ["Users"]
    assert [r["name"] for r in catalog.search(found, "F1.SQL").collect()] == ["plain"]
    assert [r["name"] for r in catalog.search(found, "Zip", "clean").collect()] == ["plain"]
    assert catalog.search(found, "zip", "pii").count() == 0
    assert catalog.search(found).count() == 2
    shown = {r["name"]: r for r in catalog.overview(found).collect()}
    assert shown["Users"]["preview"] == "email, a, b, c, d, ee +1 more"
    assert shown["Users"]["pii"] == "email(email)" and shown["plain"]["pii"] == ""
    assert [r["column"] for r in catalog.lookup(found, "plain").collect()] == ["zip"]
    with pytest.raises(KeyError):
        catalog.lookup(found, "missing")
