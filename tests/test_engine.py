import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera import cli
from tessera.errors import ConstraintError, EngineError, ParseError, TransactionError, TypeMismatch
from tessera.functions.registry import AggregateFunction, Extension, vectorised
from tessera.operators import ann
from tessera.plans import ast
from tessera.plans.parser import parse
from tessera.session import Session
from tessera.sources.files import Files
from tessera.sources.storage import Storage
from tessera.streaming.replicate import Replicator


@pytest.fixture
def db(spark, tmp_path):
    return Session(spark, str(tmp_path / "db"))


@pytest.fixture
def data(db):
    db.execute("CREATE TABLE test_data (id INTEGER PRIMARY KEY, value INTEGER, category TEXT(32))")
    db.execute("INSERT INTO test_data (id, value, category) VALUES (3, 300, 'B'), (1, 100, 'A'), (4, 400, 'B'), (2, 200, 'A'), (5, 500, 'C')")
    return db


def test_parse_shapes():
    assert parse("SELECT a + 2 * 3 FROM t").items[0].expr == ast.Binary("+", ast.Name("a"), ast.Binary("*", ast.Literal(2), ast.Literal(3)))
    assert parse("CREATE INDEX i ON t(c) UNIQUE USING BTREE").unique
    assert parse("SELECT nullable FROM t").items[0].expr == ast.Name("nullable")
    assert parse("INSERT INTO t VALUES ('it\\'s\\n')").rows[0][0] == ast.Literal("it's\n")
    assert parse("/* a */ BEGIN TRANSACTION -- b\n;").action == "begin"
    assert ast.parameters(parse("SELECT * FROM t WHERE a = ?3 AND b = ?1")) == 3
    with pytest.raises(ParseError) as error:
        parse("SELECT a\nFORM t")
    assert error.value.line == 2 and "FROM" in str(error.value)
    for bad in ("SELECT", "CREATE TABLE t (a TEXT PRIMARY KEY)", "DELETE t", "SELECT 'a", "SELECT * FROM t WHERE"):
        with pytest.raises(ParseError):
            parse(bad)


def test_select(data):
    q = lambda sql, *p: data.query(sql, *p).rows
    assert q("SELECT COUNT(*), SUM(value), AVG(value), MAX(value), MIN(value) FROM test_data") == [(5, 1500.0, 300.0, 500, 100)]
    assert data.query("SELECT id, value * 2 FROM test_data LIMIT 1").columns == ["id", "expr_1"]
    assert q("SELECT id FROM test_data LIMIT 3") == [(1,), (2,), (3,)]
    assert q("SELECT id FROM test_data ORDER BY value DESC LIMIT 2") == [(5,), (4,)]
    assert q("SELECT COUNT(*) FROM test_data WHERE value BETWEEN 150 AND 350") == [(2,)]
    assert q("SELECT id FROM test_data WHERE category = 'A' AND value > 150") == [(2,)]
    assert q("SELECT (value * 2 + 10) / 3 FROM test_data WHERE id = 2") == [(136,)]
    assert q("SELECT ABS(value - 5000) FROM test_data WHERE id = 1") == [(4900,)]
    assert q("SELECT id FROM test_data WHERE id = 1 AND id = 2") == []
    assert q("SELECT id FROM test_data WHERE (value + 1) * 2 > 900 OR (id = 1)") == [(1,), (5,)]
    assert q("SELECT id FROM test_data WHERE id > ?1 LIMIT ?2", 2, 1) == [(3,)]
    assert q("SELECT ROUND(SUM(value) / 7.0, 1), category FROM test_data") == [(214.3, "A")]
    assert q("SELECT COUNT(*) FROM test_data WHERE value > 10000") == [(0,)]
    with pytest.raises(EngineError):
        data.query("SELECT nope FROM test_data")
    with pytest.raises(EngineError):
        data.execute("SELECT * FROM test_data")
    with pytest.raises(TypeMismatch):
        data.query("SELECT category * 2 FROM test_data")
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,3)]" in data.explain("SELECT value FROM test_data WHERE id = 3")


def test_errors_reach_only_rows_that_are_read(data):
    with pytest.raises(Exception, match="division by zero"):
        data.query("SELECT 10 / (value - 100) FROM test_data").rows
    assert data.query("SELECT 10 / (value - 100) FROM test_data WHERE value = 200").rows == [(0,)]
    with pytest.raises(Exception, match="negative"):
        data.query("SELECT SQRT(0 - value) FROM test_data").rows


def test_functions(db):
    f = db.call_function
    assert f("SUBSTR", "hello", 0, 2) == "he" and f("SUBSTR", "hello", -1, 2) == "" and f("SUBSTR", "hello", 2, -1) == "ello" and f("SUBSTR", "hello", 9, 1) == ""
    assert f("TRIM", "　 a b\t\n") == "a b" and f("LENGTH", "a😀") == 2 and f("REVERSE", "ab😀") == "😀ba"
    assert f("CONCAT", "a", None, 3.0, 2.5, 7) == "a32.57"
    assert f("ROUND", 1.005, 2) == 1.0 and f("ROUND", -2.5) == -3.0 and f("CEIL", 1.2) == 2 and f("SIGN", -3) == -1
    assert f("MOD", -10, 3) == -1 and f("POW", 2, 10) == 1024.0 and f("UPPER", None) is None and f("SQRT", 9) == 3.0
    assert db.has_function("upper") and "SUM" in db.list_aggregate_functions()
    with pytest.raises(EngineError):
        f("UPPER")
    with pytest.raises(TypeMismatch):
        f("UPPER", 1)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(-1e6, 1e6), st.integers(0, 4))
def test_round_is_half_away_in_binary(spark, x, d):
    v = abs(x * 10.0**d)
    want = math.copysign((math.floor(v) + (v - math.floor(v) >= 0.5)) / 10.0**d, x)
    assert Session(spark).call_function("ROUND", x, d) == want


def test_like(db):
    db.execute("CREATE TABLE t (k TEXT(20) PRIMARY KEY)")
    db.execute("INSERT INTO t VALUES ('a_c'), ('abc'), ('abcd'), ('xa_c'), ('50%off')")
    match = lambda p: sorted(db.query("SELECT k FROM t WHERE k LIKE ?1", p).column(0))
    assert match("a_c") == ["a_c"] and match("ab%") == ["abc", "abcd"] and match("%_c") == ["a_c", "xa_c"]
    assert match("%b%") == ["abc", "abcd"] and len(match("%")) == 5 and match("50%off") == ["50%off"]


def test_constraints_and_statement_atomicity(db):
    db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT(8) NOT NULL, email TEXT(32) UNIQUE, score REAL)")
    assert db.execute("INSERT INTO users VALUES (1, 'a', 'x', 2), (2, 'b', NULL, NULL)") == 2
    for bad, kind in (
        ("INSERT INTO users (id, name) VALUES (1, 'c')", ConstraintError),
        ("INSERT INTO users (id, name) VALUES (5, 'c'), (5, 'd')", ConstraintError),
        ("INSERT INTO users (id, email) VALUES (3, 'y')", ConstraintError),
        ("INSERT INTO users (id, name) VALUES (3, 'far too long')", ConstraintError),
        ("INSERT INTO users (id, name, email) VALUES (3, 'c', 'x')", ConstraintError),
        ("UPDATE users SET id = 1 WHERE id = 2", ConstraintError),
        ("UPDATE users SET name = NULL", ConstraintError),
        ("INSERT INTO users (id, nope) VALUES (3, 1)", EngineError),
        ("INSERT INTO users (id, name) VALUES ('3', 'c')", TypeMismatch),
        ("CREATE TABLE users (id INTEGER PRIMARY KEY)", EngineError),
        ("CREATE TABLE two (a INTEGER PRIMARY KEY, b INTEGER PRIMARY KEY)", ConstraintError),
    ):
        with pytest.raises(kind):
            db.execute(bad)
    assert db.query("SELECT * FROM users").rows == [(1, "a", "x", 2.0), (2, "b", None, None)]
    assert db.execute("UPDATE users SET id = id + 1") == 2
    assert db.query("SELECT id FROM users WHERE score IS NULL").rows == [(3,)]


def test_update_goes_left_to_right_and_delete_reads_whole_predicates(data):
    data.execute("CREATE TABLE ab (id INTEGER PRIMARY KEY, a INTEGER, b INTEGER)")
    data.execute("INSERT INTO ab VALUES (1, 10, 20)")
    data.execute("UPDATE ab SET a = b, b = a")
    assert data.query("SELECT a, b FROM ab").rows == [(20, 20)]
    assert data.execute("DELETE FROM test_data WHERE id = 1 AND value = 999") == 0
    assert data.execute("DELETE FROM test_data WHERE value > 250 AND category != 'C'") == 2
    assert data.query("SELECT id FROM test_data ORDER BY id").column(0) == [1, 2, 5]
    assert data.execute("DELETE FROM test_data") == 3 and data.query("SELECT * FROM test_data").is_empty()


def test_transactions(spark, data, tmp_path):
    data.execute("BEGIN")
    data.execute("DELETE FROM test_data WHERE id > 1")
    assert len(data.query("SELECT id FROM test_data")) == 1
    assert len(Session(spark, data.storage.path).query("SELECT id FROM test_data")) == 5
    data.execute("CREATE TABLE late (id INTEGER PRIMARY KEY)")
    data.execute("ROLLBACK")
    assert len(data.query("SELECT id FROM test_data")) == 5 and "late" not in data.schemas()
    with data.transaction():
        data.execute("UPDATE test_data SET value = 0 WHERE id = 1")
    assert Session(spark, data.storage.path).query("SELECT value FROM test_data WHERE id = 1").rows == [(0,)]
    with pytest.raises(TransactionError):
        data.execute("COMMIT")
    data.execute("START TRANSACTION")
    Session(spark, data.storage.path).execute("DELETE FROM test_data WHERE id = 5")
    data.execute("DELETE FROM test_data WHERE id = 4")
    with pytest.raises(TransactionError):
        data.execute("COMMIT")
    assert data.query("SELECT id FROM test_data").column(0) == [1, 2, 3, 4] or sorted(data.query("SELECT id FROM test_data").column(0)) == [1, 2, 3, 4]
    data.storage.compact("test_data")
    assert data.storage.vacuum(unnamed_seconds=0) > 0 and len(Session(spark, data.storage.path).query("SELECT * FROM test_data")) == 4


def test_vacuum_leaves_open_transactions_and_replicated_versions(spark, data):
    data.execute("BEGIN")
    data.execute("INSERT INTO test_data VALUES (6, 600, 'C')")
    other = Session(spark, data.storage.path)
    assert other.storage.vacuum() == 0
    data.execute("COMMIT")
    assert len(data.query("SELECT * FROM test_data")) == 6
    before = data.state["version"]
    data.execute("DELETE FROM test_data WHERE id > 1")
    assert other.storage.vacuum(replicated=before) == 0 and len(other.storage.read(other.storage.manifest(before), "test_data").collect()) == 6
    assert other.storage.vacuum() > 0 and data.query("SELECT id FROM test_data").column(0) == [1]


def test_one_of_two_writers_wins(spark, data):
    from threading import Barrier, Thread

    barrier, ends = Barrier(4), []

    def write(i):
        store = Storage(spark, data.storage.path)
        state = store.manifest()
        barrier.wait()
        try:
            ends.append(store.publish(state)["version"])
        except TransactionError:
            ends.append(None)

    before = data.state["version"]
    threads = [Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(ends, key=bool) == [None, None, None, before + 1]


def test_replacing_a_file_leaves_none_beside(spark, tmp_path):
    files = Files(spark)
    assert files.write(str(tmp_path / "x.json"), "1") and not files.write(str(tmp_path / "x.json"), "2")
    assert files.write(str(tmp_path / "x.json"), "3", replace=True) and files.read(str(tmp_path / "x.json")) == "3"
    assert files.names(str(tmp_path)) == ["x.json"] or not [n for n in files.names(str(tmp_path)) if n not in ("x.json",) and not n.endswith(".crc")]


def test_small_parts_cache_and_metrics(data):
    for i in range(10, 14):
        data.execute("INSERT INTO test_data VALUES (?1, 0, 'D')", i)
    state = data.storage.manifest()
    data.storage.compact_small(state, small_parts=6)
    assert len(state["tables"]["test_data"]["parts"]) == 5
    data.storage.compact_small(state, small_bytes=0, small_parts=2)
    assert len(state["tables"]["test_data"]["parts"]) == 5
    data.storage.compact_small(state, small_parts=5)
    data.storage.publish(state)
    assert len(state["tables"]["test_data"]["parts"]) == 1 and len(data.query("SELECT * FROM test_data")) == 9
    data.cache("TEST_DATA")
    assert [len(data.query("SELECT * FROM test_data")) for _ in range(3)] == [9, 9, 9]
    data.execute("DELETE FROM test_data WHERE id >= 10")
    assert len(data.query("SELECT * FROM test_data")) == 5
    data.uncache("test_data")
    assert len(data.query("SELECT * FROM test_data")) == 5
    seen = data.metrics
    assert seen["cache_misses"] == 2 and seen["cache_hits"] >= 2 and seen["compactions"] == 1 and seen["commits"] >= 7 and seen["bytes_written"] > 0
    with pytest.raises(EngineError):
        data.cache("nothing")


def test_indexes_and_drop(data):
    data.execute("CREATE INDEX by_category ON test_data(category)")
    with pytest.raises(ConstraintError):
        data.execute("CREATE INDEX u ON test_data(category) UNIQUE")
    data.execute("CREATE INDEX u ON test_data(value) UNIQUE")
    with pytest.raises(ConstraintError):
        data.execute("INSERT INTO test_data VALUES (9, 100, 'A')")
    with pytest.raises(EngineError):
        data.execute("CREATE INDEX v ON test_data(category) USING HNSW")
    data.execute("DROP INDEX u")
    assert data.execute("INSERT INTO test_data VALUES (9, 100, 'A')") == 1
    assert len(data.query("SELECT id FROM test_data WHERE category = 'A'")) == 3
    data.execute("DROP TABLE test_data")
    assert data.state["indexes"] == {}
    data.execute("DROP TABLE IF EXISTS test_data")
    with pytest.raises(EngineError):
        data.execute("DROP TABLE test_data")


def test_prepared(data):
    p = data.prepare("SELECT id FROM test_data WHERE id > ?1 AND id < ?2")
    assert p.query(1, 5).column(0) == [2, 3, 4]
    with pytest.raises(EngineError):
        p.query(1)
    assert data.prepare("INSERT INTO test_data VALUES (?1, ?2, ?3)").execute(9, 9, "Z") == 1
    assert data.prepare("UPDATE test_data SET value = ?2 WHERE id = ?1").execute(9, 10) == 1
    assert data.prepare("DELETE FROM test_data WHERE id = ?1").execute(9) == 1


def test_vectors(db):
    db.execute("CREATE TABLE e (id INTEGER PRIMARY KEY, v VECTOR(3), text TEXT(32))")
    db.execute("INSERT INTO e VALUES (1, [1.0, 0.0, 0.0], 'x vector'), (2, [0.0, 1.0, 0.0], 'y'), (3, [0, 0, 1], 'z'), (4, [0.7, 0.7, 0.0], 'xy vector'), (5, NULL, 'none')")
    q = lambda sql, *p: db.query(sql, *p).rows
    assert q("SELECT COSINE_SIMILARITY(v, [1.0, 0.0, 0.0]), DOT_PRODUCT(v, [1.0, 1.0, 0.0]) FROM e WHERE id = 1") == [(1.0, 1.0)]
    assert q("SELECT id FROM e ORDER BY COSINE_SIMILARITY(v, ?1) DESC LIMIT 2", [0.9, 0.1, 0.0]) == [(1,), (4,)]
    assert q("SELECT COUNT(*) FROM e WHERE COSINE_SIMILARITY(v, [1.0, 0.0, 0.0]) > 0.5 AND text LIKE '%vector%'") == [(2,)]
    assert q("SELECT v FROM e WHERE id = 5") == [(None,)]
    with pytest.raises(Exception, match="zero vector"):
        q("SELECT COSINE_SIMILARITY(v, [0.0, 0.0, 0.0]) FROM e WHERE id = 1")
    with pytest.raises(Exception, match="dimension"):
        q("SELECT DOT_PRODUCT(v, [1.0, 0.0]) FROM e WHERE id = 1")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO e VALUES (6, [1.0], 'short')")
    rows = db.table("e").where("v is not null")
    for index in (ann.ExactIndex(rows, "id", "v"), ann.LshIndex(rows, "id", "v"), ann.IvfIndex(rows, "id", "v", cells=2)):
        assert index.search([1.0, 0.0, 0.0], 1).first()["id"] == 1
    index = ann.ExactIndex(rows, "id", "v")
    index.remove([1])
    assert len(index) == 3 and index.search([1.0, 0.0, 0.0], 1).first()["id"] == 4


def test_ann_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 16))
    vectors = [(i, (centres[i % 8] + 0.2 * rng.standard_normal(16)).tolist()) for i in range(800)]
    rows = spark.createDataFrame(vectors, "id long, vector array<double>")
    exact, ivf, lsh = ann.ExactIndex(rows), ann.IvfIndex(rows, probes=2), ann.LshIndex(rows, tables=8)
    found = {"ivf": 0, "lsh": 0}
    for i in (0, 100, 201, 302):
        want = {r["id"] for r in exact.search(vectors[i][1], 10).collect()}
        for name, index in (("ivf", ivf), ("lsh", lsh)):
            found[name] += len(want & {r["id"] for r in index.search(vectors[i][1], 10).collect()})
    assert found["ivf"] >= 36 and found["lsh"] >= 36


def test_registered_ivf_recall(spark, tmp_path):
    import numpy as np
    from tessera.queries import _index

    rng = np.random.default_rng(2)
    rows = [(i, (v * (1 + i % 3)).tolist()) for i, v in enumerate(rng.standard_normal((600, 16)))] + [(600, [0.0] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    exact, ivf = ([tuple(r) for r in _index(kind)(spark, str(tmp_path)).collect()] for kind in ("exact", "ivf"))
    assert len(ivf) == 10 and ivf == exact
    table = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    index, all_ = ann.IvfIndex(table, "vec_id", "embedding"), ann.ExactIndex(table, "vec_id", "embedding")
    for query in (rows[7][1], rows[300][1], [0.0] * 16):
        assert index.search(query, 10).collect() == all_.search(query, 10).collect()


def test_extensions(spark, db, tmp_path):
    db.registry.register(Extension("d", "1", [vectorised("DOUBLE", lambda x: x * 2, ("number",), "int")]))
    assert db.call_function("DOUBLE", 21) == 42
    with pytest.raises(EngineError):
        db.registry.register(Extension("d2", "1", [vectorised("DOUBLE", lambda x: x, ("number",), "int")]))
    with pytest.raises(EngineError):
        db.registry.register(Extension("needs", "1", dependencies=("nothing",)))
    db.registry.unregister("d")
    assert not db.has_function("DOUBLE")
    mean = AggregateFunction("MEAN2", 1, lambda: (0, 0.0), lambda s, v: s if v is None else (s[0] + 1, s[1] + v), lambda s: s[1] / s[0] if s[0] else None)
    db.registry.register(Extension("m", "1", [], [mean]))
    db.execute("CREATE TABLE n (id INTEGER PRIMARY KEY, x REAL)")
    db.execute("INSERT INTO n VALUES (1, 1), (2, 3), (3, NULL)")
    assert db.query("SELECT MEAN2(x) AS m FROM n").rows == [(2.0,)]
    merged = AggregateFunction("MEAN3", mean.arguments, mean.create, mean.accumulate, mean.finalize, lambda s, t: (s[0] + t[0], s[1] + t[1]))
    db.registry.register(Extension("m3", "1", [], [merged]))
    assert db.query("SELECT MEAN3(x) + 1.0 AS m, COUNT(*) AS n, MEAN2(x) AS o FROM n WHERE id < 9").rows == [(3.0, 3, 2.0)]
    assert db.query("SELECT MEAN3(x) AS m, COUNT(*) AS n FROM n WHERE id > 9").rows == [(None, 0)]
    (tmp_path / "ext.py").write_text("from tessera.functions.registry import Extension, vectorised\n\ndef create_extension():\n    return Extension('plus', '1', [vectorised('PLUSONE', lambda x: x + 1, ('int',), 'int')])\n")
    db.execute(f"CREATE EXTENSION plus WITH PATH '{tmp_path / 'ext.py'}'")
    again = Session(spark, db.storage.path)
    assert again.has_function("PLUSONE") and "plus" in dict(again.list_extensions())
    again.execute("DROP EXTENSION plus")
    assert not Session(spark, db.storage.path).has_function("PLUSONE")
    vector = db.call_function("EMBED", "some words")
    assert len(vector) == 768 and abs(sum(x * x for x in vector) - 1) < 1e-9
    with pytest.raises(EngineError):
        db.call_function("EMBED", "some words", "elsewhere")


def test_replication(spark, data, tmp_path):
    replica = Replicator(spark, data.storage.path, str(tmp_path / "replica"))
    replica.run_once()
    base = replica.snapshot()
    data.execute("DELETE FROM test_data WHERE id > 2")
    data.execute("INSERT INTO test_data VALUES (7, 7, 'new')")
    replica.run_once()
    assert replica.restore(str(tmp_path / "now")) == data.state["version"]
    assert sorted(Session(spark, str(tmp_path / "now")).query("SELECT id FROM test_data").column(0)) == [1, 2, 7]
    replica.restore(str(tmp_path / "then"), base)
    assert len(Session(spark, str(tmp_path / "then")).query("SELECT id FROM test_data")) == 5
    replica.prune(1)
    assert replica.bases() == [base]
    replica.files.delete(f"{replica.path}/commits/{base + 1:012d}.json")
    with pytest.raises(EngineError, match="missing"):
        replica.restore(str(tmp_path / "gap"))


def test_csv_and_cli(spark, db, tmp_path, capsys):
    (tmp_path / "in.csv").write_text("id,name\n1,a\n2,b,ragged,row\n3,c\n")
    shell = cli.Shell(db)
    shell.run(f"CREATE TABLE c (id INTEGER PRIMARY KEY, name TEXT(8), score REAL);\nCOPY c FROM '{tmp_path / 'in.csv'}';\nSELECT id, name FROM c ORDER BY id;\n.mode json\nSELECT name FROM c WHERE name = 'a;b' OR id = 1;\n.tables\n.schema c\n.stats")
    out = capsys.readouterr().out
    assert "2 rows copied" in out and "1  | a" in out and '{"name": "a"}' in out and "score REAL" in out and not shell.failed
    shell.run("SELECT * FROM nope;\n.nope\n")
    assert shell.failed
    db.copy_to("c", str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
