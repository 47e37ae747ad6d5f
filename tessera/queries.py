"""The engine's queries over the driver's tables, and the SQL each is compared with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .functions.registry import AggregateFunction, Extension, vectorised
from .operators import ann
from .session import Session
from .sources import storage
from .streaming.replicate import Replicator

#: Primary keys of the tables; lineitem and conversations have none of one column.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None,
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": None, "conversations": None,
}


def open_tables(spark: SparkSession, sf_dir: str, *names: str, path: str | None = None) -> Session:
    """A session that reads the named tables of a folder."""
    session = Session(spark, path)
    for name in names:
        session.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name])
    return session


def new_database(spark: SparkSession, name: str) -> str:
    """A path in the folder that all executors see; in a temporary one only where all run on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        shared = tempfile.mkdtemp(prefix="tessera-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# One-statement queries: name -> (table, statement, SQL to compare with; None if it is the same text).

_V0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_E = "CAST(embedding AS DOUBLE[])"
_WS = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_ROUND = "CASE WHEN {x} < 0 THEN -1 ELSE 1 END * (floor(abs({x}) * 100.0) + CASE WHEN abs({x}) * 100.0 - floor(abs({x}) * 100.0) >= 0.5 THEN 1.0 ELSE 0.0 END) / 100.0"

STATEMENTS: dict[str, tuple[str, str, str | None]] = {
    "flagship": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.0 ORDER BY o_totalprice DESC LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "scan_all_limit": ("customer", "SELECT * FROM customer LIMIT 100", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100"),
    "scan_all": ("supplier", "SELECT * FROM supplier", None),
    "project_columns": ("customer", "SELECT c_name, c_acctbal FROM customer", None),
    "project_arith": ("lineitem", "SELECT l_orderkey, ROUND(l_extendedprice * (1.0 - l_discount), 4) AS net FROM lineitem", "SELECT l_orderkey, (floor(abs(l_extendedprice * (1.0::DOUBLE - l_discount)) * 10000.0) + CASE WHEN abs(l_extendedprice * (1.0::DOUBLE - l_discount)) * 10000.0 - floor(abs(l_extendedprice * (1.0::DOUBLE - l_discount)) * 10000.0) >= 0.5 THEN 1.0 ELSE 0.0 END) / 10000.0 AS net FROM lineitem"),
    "project_unnamed": ("orders", "SELECT o_orderkey, o_orderkey * 2 + 1 FROM orders", "SELECT o_orderkey, o_orderkey * 2 + 1 AS expr_1 FROM orders"),
    "project_constant": ("region", "SELECT 1 + 2 * 3 AS seven, UPPER('abc') AS big, 7 / 2 AS half FROM region", "SELECT CAST(7 AS BIGINT) AS seven, 'ABC' AS big, CAST(3 AS BIGINT) AS half FROM region"),
    "select_without_from": ("region", "SELECT 10 - 6 / 3 AS eight, 7 % 4 AS three, ABS(-2.5) AS more", "SELECT CAST(8 AS BIGINT) AS eight, CAST(3 AS BIGINT) AS three, CAST(2.5 AS DOUBLE) AS more"),
    "int_division": ("orders", "SELECT o_orderkey, o_orderkey / 7 AS q FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q FROM orders"),
    "modulo": ("orders", "SELECT o_orderkey, o_orderkey % 7 AS m, (0 - o_orderkey) % 7 AS n FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m, (0 - o_orderkey) % 7 AS n FROM orders"),
    "text_concat": ("customer", "SELECT c_custkey, c_name + '-' + c_mktsegment AS both FROM customer", "SELECT c_custkey, c_name || '-' || c_mktsegment AS \"both\" FROM customer"),
    "pk_lookup": ("orders", "SELECT * FROM orders WHERE o_orderkey = 42", None),
    "pk_range": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 200", None),
    "pk_between": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 50 AND 60", None),
    "pk_and_other": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderkey > 5 AND o_orderkey > 10 AND o_orderkey != 12 AND o_orderstatus = 'O'", None),
    "index_scan_eq": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'FURNITURE'", None),
    "index_or": ("customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE' OR c_nationkey = 3", None),
    "filter_and_or": ("orders", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND (o_totalprice > 50000.0 AND o_custkey < 1000)", None),
    "filter_not_equal": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'", None),
    "filter_unequal_sign": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'", None),
    "filter_expr_lhs": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2.0 >= 90.0", None),
    "filter_int_real": ("customer", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_custkey < 100.5", None),
    "filter_function": ("part", "SELECT p_partkey FROM part WHERE LENGTH(p_name) > 10 AND UPPER(p_brand) = 'BRAND#11'", None),
    "filter_is_null": ("customer", "SELECT c_custkey FROM customer WHERE c_name IS NULL", None),
    "filter_is_not_null": ("customer", "SELECT c_custkey FROM customer WHERE c_name IS NOT NULL AND c_custkey <= 20", None),
    "filter_unlike_types": ("customer", "SELECT c_custkey FROM customer WHERE c_name = 5 OR c_custkey = 7", "SELECT c_custkey FROM customer WHERE c_custkey = 7"),
    "comments": ("region", "-- all\nSELECT r_name /* the name */ FROM region;", "SELECT r_name FROM region"),
    "like_prefix": ("part", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%'", None),
    "like_suffix": ("part", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%2'", None),
    "like_contains": ("part", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'", None),
    "like_exact": ("part", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#12'", None),
    "like_underscore_literal": ("part", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand_1%'", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand_1')"),
    "order_multi": ("customer", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC, c_acctbal DESC LIMIT 50", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50"),
    "order_desc_limit": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "order_unselected": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_custkey LIMIT 25", "SELECT o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 25"),
    "order_expr": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey % 10 DESC, o_totalprice LIMIT 25", "SELECT o_orderkey FROM orders ORDER BY o_orderkey % 10 DESC, o_totalprice, o_orderkey LIMIT 25"),
    "order_alias": ("orders", "SELECT o_orderkey, o_totalprice * 2.0 AS twice FROM orders ORDER BY twice DESC LIMIT 15", "SELECT o_orderkey, o_totalprice * 2.0::DOUBLE AS twice FROM orders ORDER BY twice DESC, o_orderkey LIMIT 15"),
    "order_range": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 10 AND 500 ORDER BY o_totalprice LIMIT 5", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 10 AND 500 ORDER BY o_totalprice, o_orderkey LIMIT 5"),
    "agg_count": ("lineitem", "SELECT COUNT(*) AS n, COUNT(l_quantity) AS m FROM lineitem", None),
    "agg_sum": ("lineitem", "SELECT ROUND(SUM(l_quantity), 2) AS total FROM lineitem", "SELECT round(sum(l_quantity), 2) AS total FROM lineitem"),
    "agg_sum_int": ("orders", "SELECT SUM(o_orderkey) AS total FROM orders", "SELECT sum(o_orderkey::DOUBLE) AS total FROM orders"),
    "agg_avg": ("orders", "SELECT ROUND(AVG(o_totalprice), 4) AS mean FROM orders", "SELECT round(avg(o_totalprice), 4) AS mean FROM orders"),
    "agg_min_max": ("orders", "SELECT MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, MIN(o_orderstatus) AS first, MAX(o_custkey) AS last FROM orders", None),
    "agg_multi": ("lineitem", "SELECT COUNT(*) AS n, MIN(l_discount) AS low, MAX(l_tax) AS high, AVG(l_linenumber) AS mean FROM lineitem", "SELECT count(*) AS n, min(l_discount) AS low, max(l_tax) AS high, avg(l_linenumber) AS mean FROM lineitem"),
    "agg_filtered": ("orders", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS high FROM orders WHERE o_orderstatus = 'F' AND o_custkey BETWEEN 10 AND 500", None),
    "agg_expr": ("lineitem", "SELECT MAX(l_quantity * l_tax) AS high, COUNT(l_quantity + 1.0) AS n FROM lineitem", "SELECT max(l_quantity * l_tax) AS high, count(l_quantity + 1.0) AS n FROM lineitem"),
    "agg_empty": ("orders", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean, MIN(o_custkey) AS low, MAX(o_orderstatus) AS high FROM orders WHERE o_orderkey < 0", None),
    "agg_plain_column": ("orders", "SELECT o_orderkey, o_custkey, COUNT(*) AS n FROM orders WHERE o_orderkey > 10", "SELECT min(o_orderkey) AS o_orderkey, arg_min(o_custkey, o_orderkey) AS o_custkey, count(*) AS n FROM orders WHERE o_orderkey > 10"),
    "agg_order": ("orders", "SELECT COUNT(*) AS n FROM orders ORDER BY o_orderkey LIMIT 1", "SELECT count(*) AS n FROM orders"),
    "fn_upper_lower": ("part", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l FROM part", None),
    "fn_length": ("documents", "SELECT doc_id, LENGTH(text) AS n FROM documents", None),
    "fn_trim": ("documents", "SELECT doc_id, TRIM(CONCAT('\\t ', text, ' \\n')) AS t FROM documents", f"SELECT doc_id, regexp_replace(regexp_replace(text, '^{_WS}', ''), '{_WS}$', '') AS t FROM documents"),
    "fn_ltrim": ("part", "SELECT p_partkey, LTRIM(' \\t' + p_name + ' ') AS t FROM part", "SELECT p_partkey, p_name || ' ' AS t FROM part"),
    "fn_rtrim": ("part", "SELECT p_partkey, RTRIM(' ' + p_name + '\\n ') AS t FROM part", "SELECT p_partkey, ' ' || p_name AS t FROM part"),
    "fn_substr": ("documents", "SELECT doc_id, SUBSTR(text, 3, 12) AS a, SUBSTR(text, 5) AS b FROM documents", "SELECT doc_id, substr(text, 3, 12) AS a, substr(text, 5) AS b FROM documents"),
    "fn_substr_edges": ("part", "SELECT p_partkey, SUBSTR(p_name, 0, 3) AS a, SUBSTR(p_name, -2, 3) AS b, SUBSTR(p_name, 2, -1) AS c FROM part", "SELECT p_partkey, substr(p_name, 1, 3) AS a, '' AS b, substr(p_name, 2) AS c FROM part"),
    "fn_replace": ("documents", "SELECT doc_id, REPLACE(text, 'the', '<>') AS r FROM documents", None),
    "fn_concat": ("customer", "SELECT c_custkey, CONCAT(c_name, ':', c_custkey, ':', NULL, 3.0, ':', 2.5) AS c FROM customer", "SELECT c_custkey, concat(c_name, ':', c_custkey, ':3:2.5') AS c FROM customer"),
    "fn_reverse": ("part", "SELECT p_partkey, REVERSE(p_name) AS r FROM part", None),
    "fn_abs": ("customer", "SELECT c_custkey, ABS(c_acctbal) AS a, ABS(0 - c_custkey) AS b FROM customer", None),
    "fn_ceil": ("customer", "SELECT c_custkey, CEIL(c_acctbal) AS c FROM customer", "SELECT c_custkey, ceil(c_acctbal)::BIGINT AS c FROM customer"),
    "fn_floor": ("customer", "SELECT c_custkey, FLOOR(c_acctbal) AS f FROM customer", "SELECT c_custkey, floor(c_acctbal)::BIGINT AS f FROM customer"),
    "fn_round": ("customer", "SELECT c_custkey, ROUND(c_acctbal * 0.37, 2) AS r FROM customer", "SELECT c_custkey, " + _ROUND.format(x="(c_acctbal * 0.37::DOUBLE)") + " AS r FROM customer"),
    "fn_sqrt": ("part", "SELECT p_partkey, ROUND(SQRT(p_retailprice), 6) AS s FROM part", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s FROM part"),
    "fn_pow": ("part", "SELECT p_partkey, POW(p_size, 2) AS s FROM part", "SELECT p_partkey, pow(p_size::DOUBLE, 2) AS s FROM part"),
    "fn_mod": ("part", "SELECT p_partkey, MOD(p_partkey, 7) AS m, MOD(0 - p_size, 3) AS n FROM part", "SELECT p_partkey, p_partkey % 7 AS m, (0 - p_size::BIGINT) % 3 AS n FROM part"),
    "fn_sign": ("customer", "SELECT c_custkey, SIGN(c_acctbal) AS s FROM customer", "SELECT c_custkey, sign(c_acctbal)::BIGINT AS s FROM customer"),
}

# With the vector of vec_id 0 as parameter ?1.
VECTOR_STATEMENTS: dict[str, tuple[str, str]] = {
    "vec_cosine": ("SELECT vec_id, ROUND(COSINE_SIMILARITY(embedding, ?1), 6) AS s FROM embeddings", f"SELECT vec_id, round(list_cosine_similarity({_E}, {_V0}), 6) AS s FROM embeddings"),
    "vec_euclid": ("SELECT vec_id, ROUND(EUCLIDEAN_DISTANCE(embedding, ?1), 6) AS d FROM embeddings", f"SELECT vec_id, round(list_distance({_E}, {_V0}), 6) AS d FROM embeddings"),
    "vec_dot": ("SELECT vec_id, ROUND(DOT_PRODUCT(embedding, ?1), 6) AS p FROM embeddings", f"SELECT vec_id, round(list_dot_product({_E}, {_V0}), 6) AS p FROM embeddings"),
    "vec_normalize": ("SELECT vec_id, ROUND(DOT_PRODUCT(L2_NORMALIZE(embedding), ?1), 6) AS p FROM embeddings", f"SELECT vec_id, round(list_dot_product({_E}, {_V0}) / sqrt(list_dot_product({_E}, {_E})), 6) AS p FROM embeddings"),
    "vec_knn": ("SELECT vec_id, label FROM embeddings ORDER BY COSINE_SIMILARITY(embedding, ?1) DESC LIMIT 10", f"SELECT vec_id, label FROM embeddings ORDER BY list_cosine_similarity({_E}, {_V0}) DESC, vec_id LIMIT 10"),
    "vec_knn_filtered": ("SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY EUCLIDEAN_DISTANCE(embedding, ?1) LIMIT 5", f"SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY list_distance({_E}, {_V0}), vec_id LIMIT 5"),
    "vec_threshold": ("SELECT vec_id FROM embeddings WHERE COSINE_SIMILARITY(embedding, ?1) > 0.3", f"SELECT vec_id FROM embeddings WHERE list_cosine_similarity({_E}, {_V0}) > 0.3"),
    "vec_range": ("SELECT vec_id FROM embeddings WHERE EUCLIDEAN_DISTANCE(embedding, ?1) < 1.2 AND label < 8", f"SELECT vec_id FROM embeddings WHERE list_distance({_E}, {_V0}) < 1.2 AND label < 8"),
}


def _statement(table: str, sql: str):
    return lambda spark, sf_dir: open_tables(spark, sf_dir, table).query(sql).df


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").select(F.col("embedding").cast("array<double>"))
    return rows.first()[0]


def _vector_statement(sql: str):
    return lambda spark, sf_dir: open_tables(spark, sf_dir, "embeddings").query(sql, _first_vector(spark, sf_dir)).df


def prepared_select(spark, sf_dir):
    prepared = open_tables(spark, sf_dir, "orders").prepare("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > ?1 AND o_orderkey < ?2 AND o_orderstatus = ?3 LIMIT ?4")
    return prepared.query(10, 900, "O", 30).df


def _index(kind: str):
    def run(spark, sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        make = {"exact": ann.ExactIndex, "lsh": ann.LshIndex, "ivf": ann.IvfIndex}[kind]
        found = make(rows, "vec_id", "embedding").search(_first_vector(spark, sf_dir), 10)
        return found.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))

    return run


def knn_batch(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = ann.knn_batch(rows, rows.where("vec_id % 100 = 0"), 5, "vec_id", "embedding")
    return found.select("query_id", "rank", F.round("similarity", 6).alias("similarity"))


def _customers(spark, sf_dir, name: str) -> Session:
    """A database with a table of the customers' keys, names and balances, as copied from the driver's."""
    session = open_tables(spark, sf_dir, "customer", path=new_database(spark, name))
    session.execute("CREATE TABLE accounts (id INTEGER PRIMARY KEY, name TEXT(64) NOT NULL, balance REAL, segment TEXT(32))")
    path = new_database(spark, "csv")
    session.query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer").df.write.option("header", "true").csv(path)
    session.copy_from("accounts", path)
    return session


def csv_copy(spark, sf_dir):
    return _customers(spark, sf_dir, "csv_copy").query("SELECT * FROM accounts").df


def dml_insert(spark, sf_dir):
    session = _customers(spark, sf_dir, "dml_insert")
    session.execute("INSERT INTO accounts (id, name, balance) VALUES (-1, 'new', 2), (-2, 'newer', 1.5 * 2.0)")
    return session.query("SELECT * FROM accounts").df


def dml_update(spark, sf_dir):
    session = _customers(spark, sf_dir, "dml_update")
    session.execute("UPDATE accounts SET balance = balance + 100.0, name = name + '!' WHERE segment = 'FURNITURE' AND id > 10")
    return session.query("SELECT * FROM accounts").df


def dml_delete(spark, sf_dir):
    session = _customers(spark, sf_dir, "dml_delete")
    session.execute("DELETE FROM accounts WHERE balance < 0.0 OR id = 5")
    return session.query("SELECT * FROM accounts").df


def index_table(spark, sf_dir):
    session = _customers(spark, sf_dir, "index_table")
    session.execute("CREATE INDEX by_segment ON accounts(segment) USING BTREE")
    session.execute("UPDATE accounts SET balance = balance * 2.0")
    return session.query("SELECT id, balance FROM accounts WHERE segment = 'FURNITURE'").df


def txn_commit(spark, sf_dir):
    session = _customers(spark, sf_dir, "txn_commit")
    with session.transaction():
        session.execute("DELETE FROM accounts WHERE id > 50")
        session.execute("UPDATE accounts SET balance = 0.0 WHERE id <= 10")
    return session.query("SELECT * FROM accounts").df


def txn_rollback(spark, sf_dir):
    session = _customers(spark, sf_dir, "txn_rollback")
    session.execute("BEGIN")
    session.execute("DELETE FROM accounts")
    session.execute("ROLLBACK")
    return session.query("SELECT * FROM accounts").df


def compact_table(spark, sf_dir):
    session = _customers(spark, sf_dir, "compact_table")
    session.execute("INSERT INTO accounts (id, name) VALUES (-1, 'new')")
    session.storage.compact("accounts")
    session.storage.vacuum()
    return session.query("SELECT * FROM accounts").df


def compact_auto(spark, sf_dir):
    """As many small inserts as make one commit join their parts."""
    session = Session(spark, new_database(spark, "compact_auto"))
    session.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    with session.transaction():
        for i in range(storage.SMALL_PARTS):
            session.execute("INSERT INTO t VALUES (?1, ?2)", i, i * i)
    parts = len(session.state["tables"]["t"]["parts"])
    return session.query("SELECT id, n FROM t").df.withColumn("parts", F.lit(parts))


def drop_table(spark, sf_dir):
    session = _customers(spark, sf_dir, "drop_table")
    session.execute("DROP TABLE accounts")
    session.execute("DROP TABLE IF EXISTS accounts")
    session.execute("CREATE TABLE accounts (id INTEGER PRIMARY KEY, name TEXT(64))")
    session.execute("INSERT INTO accounts VALUES (1, 'one'), (2, 'two')")
    return session.query("SELECT * FROM accounts").df


def drop_index(spark, sf_dir):
    session = _customers(spark, sf_dir, "drop_index")
    session.execute("CREATE INDEX by_name ON accounts(name) UNIQUE")
    session.execute("DROP INDEX by_name")
    session.execute("UPDATE accounts SET name = 'same' WHERE id <= 2")
    return session.query("SELECT id, name FROM accounts WHERE name = 'same'").df


def extension_reload(spark, sf_dir):
    session = _customers(spark, sf_dir, "extension_reload")
    session.execute("DROP EXTENSION text")
    lost = session.has_function("REVERSE")
    session.execute("CREATE EXTENSION text")
    return session.query("SELECT id, REVERSE(name) AS back FROM accounts").df.withColumn("lost", F.lit(not lost))


def copy_to(spark, sf_dir):
    session, path = _customers(spark, sf_dir, "copy_to"), new_database(spark, "csv")
    session.copy_to("accounts", path)
    return spark.read.option("header", "true").schema("id long, name string, balance double, segment string").csv(path)


def limit_parameter(spark, sf_dir):
    return open_tables(spark, sf_dir, "orders").query("SELECT o_orderkey FROM orders WHERE o_totalprice > ?1 LIMIT ?2", 1000.0, 7).df


def failed_statement(spark, sf_dir):
    """A statement that fails in its last row leaves nothing, in and outside of a transaction."""
    session = _customers(spark, sf_dir, "failed_statement")
    for _ in range(2):
        try:
            session.execute("INSERT INTO accounts (id, name) VALUES (-1, 'new'), (1, 'taken')")
        except EngineError:
            pass
        else:
            raise AssertionError("a taken key was inserted")
        if not session.in_transaction:
            session.execute("BEGIN")
    session.execute("COMMIT")
    return session.query("SELECT * FROM accounts").df


def reopened(spark, sf_dir):
    """What a second session on the same path sees; a part that was never committed is not there."""
    session = _customers(spark, sf_dir, "reopened")
    session.execute("CREATE INDEX by_segment ON accounts(segment)")
    session.execute("BEGIN")
    session.execute("DELETE FROM accounts WHERE id > 3")
    return Session(spark, session.storage.path).query("SELECT * FROM accounts").df


def cached_table(spark, sf_dir):
    session = _customers(spark, sf_dir, "cached_table")
    session.cache("accounts")
    session.query("SELECT COUNT(*) FROM accounts").rows
    session.execute("DELETE FROM accounts WHERE id = 5")
    session.query("SELECT COUNT(*) FROM accounts").rows
    out = session.query("SELECT id, balance FROM accounts").df
    return out.withColumn("hits", F.lit(session.metrics["cache_hits"])).withColumn("misses", F.lit(session.metrics["cache_misses"]))


def replicate_prune(spark, sf_dir):
    session = _customers(spark, sf_dir, "source")
    replica = Replicator(spark, session.storage.path, new_database(spark, "replica"))
    for i in range(3):
        session.execute("DELETE FROM accounts WHERE id = ?1", i + 1)
        replica.snapshot()
    replica.prune(keep=1)
    target = new_database(spark, "restored")
    replica.restore(target)
    return Session(spark, target).query("SELECT * FROM accounts").df.withColumn("bases", F.lit(len(replica.bases())))


def replicate_restore(spark, sf_dir):
    session = _customers(spark, sf_dir, "source")
    replica = Replicator(spark, session.storage.path, new_database(spark, "replica"))
    replica.run_once()
    session.execute("DELETE FROM accounts WHERE id > 100")
    replica.run_once()
    target = new_database(spark, "restored")
    replica.restore(target)
    return Session(spark, target).query("SELECT * FROM accounts").df


def restore_earlier(spark, sf_dir):
    session = _customers(spark, sf_dir, "source")
    replica = Replicator(spark, session.storage.path, new_database(spark, "replica"))
    before = session.state["version"]
    replica.snapshot()
    session.execute("DELETE FROM accounts WHERE id > 100")
    replica.run_once()
    target = new_database(spark, "restored")
    replica.restore(target, before)
    return Session(spark, target).query("SELECT * FROM accounts").df


def ext_scalar(spark, sf_dir):
    session = open_tables(spark, sf_dir, "orders")
    session.registry.register(Extension("double", "1.0", [vectorised("DOUBLE", lambda x: x * 2, ("number",), "real")]))
    return session.query("SELECT o_orderkey, DOUBLE(o_totalprice) AS twice FROM orders WHERE DOUBLE(o_custkey) < 1000").df


def _spread(state, value):
    return state if value is None else (value if state[0] is None else min(state[0], value), value if state[1] is None else max(state[1], value))


def ext_aggregate(spark, sf_dir):
    session = open_tables(spark, sf_dir, "orders")
    spread = AggregateFunction("SPREAD", 1, lambda: (None, None), _spread, lambda s: None if s[0] is None else float(s[1] - s[0]), lambda s, t: _spread(_spread(s, t[0]), t[1]))
    session.registry.register(Extension("spread", "1.0", [], [spread]))
    return session.query("SELECT SPREAD(o_totalprice) AS spread FROM orders").df


def embed_text(spark, sf_dir):
    session = open_tables(spark, sf_dir, "part")
    return session.query("SELECT p_partkey, ROUND(COSINE_SIMILARITY(EMBED(p_name), EMBED(UPPER(p_name))), 6) AS same FROM part").df


def kv_table(spark, sf_dir):
    """A table of keys and values: set, overwrite, delete and scan."""
    session = Session(spark, new_database(spark, "kv"))
    session.execute("CREATE TABLE kv (k TEXT(64) PRIMARY KEY, v TEXT(256))")
    for i in range(4):
        session.execute("INSERT INTO kv VALUES (?1, ?2)", f"key{i}", f"value{i}")
    session.execute("UPDATE kv SET v = 'other' WHERE k = 'key1'")
    session.execute("DELETE FROM kv WHERE k = 'key2'")
    return session.query("SELECT * FROM kv WHERE k >= 'key1' AND k < 'key9' ORDER BY k").df


_ACCOUNTS = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer"

OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "prepared_select": (prepared_select, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 10 AND o_orderkey < 900 AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 30"),
    "ann_exact": (_index("exact"), f"SELECT vec_id, round(1 - list_cosine_similarity({_E}, {_V0}), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity({_E}, {_V0}), vec_id LIMIT 10"),
    "ann_lsh": (_index("lsh"), None),
    # Every cell that can hold one of the nearest is searched, so the result is the exact one.
    "ann_ivf": (_index("ivf"), f"SELECT vec_id, round(1 - list_cosine_similarity({_E}, {_V0}), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity({_E}, {_V0}), vec_id LIMIT 10"),
    "knn_batch": (knn_batch, f"SELECT query_id, rank, round(s, 6) AS similarity FROM (SELECT q.vec_id AS query_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, e.vec_id) AS INT) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE rank <= 5"),
    "csv_copy": (csv_copy, _ACCOUNTS),
    "dml_insert": (dml_insert, f"{_ACCOUNTS} UNION ALL VALUES (-1, 'new', 2.0, NULL), (-2, 'newer', 3.0, NULL)"),
    "dml_update": (dml_update, "SELECT c_custkey AS id, CASE WHEN hit THEN c_name || '!' ELSE c_name END AS name, CASE WHEN hit THEN c_acctbal + 100.0 ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM (SELECT *, c_mktsegment = 'FURNITURE' AND c_custkey > 10 AS hit FROM customer)"),
    "dml_delete": (dml_delete, f"{_ACCOUNTS} WHERE NOT (c_acctbal < 0 OR c_custkey = 5)"),
    "index_table": (index_table, "SELECT c_custkey AS id, c_acctbal * 2 AS balance FROM customer WHERE c_mktsegment = 'FURNITURE'"),
    "txn_commit": (txn_commit, "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey <= 10 THEN 0.0 ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey <= 50"),
    "txn_rollback": (txn_rollback, _ACCOUNTS),
    "compact_table": (compact_table, f"{_ACCOUNTS} UNION ALL VALUES (-1, 'new', NULL, NULL)"),
    "compact_auto": (compact_auto, "SELECT i AS id, i * i AS n, CAST(1 AS INT) AS parts FROM (SELECT unnest(range(16)) AS i)"),
    "drop_table": (drop_table, "SELECT CAST(1 AS BIGINT) AS id, 'one' AS name UNION ALL SELECT 2, 'two'"),
    "drop_index": (drop_index, "SELECT c_custkey AS id, 'same' AS name FROM customer WHERE c_custkey <= 2"),
    "extension_reload": (extension_reload, "SELECT c_custkey AS id, reverse(c_name) AS back, true AS lost FROM customer"),
    "copy_to": (copy_to, _ACCOUNTS),
    "limit_parameter": (limit_parameter, "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.0 ORDER BY o_orderkey LIMIT 7"),
    "failed_statement": (failed_statement, _ACCOUNTS),
    "reopened": (reopened, _ACCOUNTS),
    "cached_table": (cached_table, "SELECT c_custkey AS id, c_acctbal AS balance, CAST(1 AS INT) AS hits, CAST(2 AS INT) AS misses FROM customer WHERE c_custkey != 5"),
    "replicate_prune": (replicate_prune, f"SELECT *, CAST(1 AS INT) AS bases FROM ({_ACCOUNTS} WHERE c_custkey NOT IN (1, 2, 3))"),
    "replicate_restore": (replicate_restore, f"{_ACCOUNTS} WHERE c_custkey <= 100"),
    "restore_earlier": (restore_earlier, _ACCOUNTS),
    "ext_scalar": (ext_scalar, "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_custkey * 2 < 1000"),
    "ext_aggregate": (ext_aggregate, "SELECT max(o_totalprice) - min(o_totalprice) AS spread FROM orders"),
    "embed_text": (embed_text, "SELECT p_partkey, 1.0::DOUBLE AS same FROM part"),
    "kv_table": (kv_table, "SELECT 'key1' AS k, 'other' AS v UNION ALL SELECT 'key3', 'value3'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _statement(table, sql) for k, (table, sql, _) in STATEMENTS.items()}
    out |= {k: _vector_statement(sql) for k, (sql, _) in VECTOR_STATEMENTS.items()}
    return out | {k: run for k, (run, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: other or sql for k, (_, sql, other) in STATEMENTS.items()}
    out |= {k: other for k, (_, other) in VECTOR_STATEMENTS.items()}
    return out | {k: sql for k, (_, sql) in OTHERS.items() if sql}
