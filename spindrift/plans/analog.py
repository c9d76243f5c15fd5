"""The driver's star-schema tables read as an index: suppliers are files, parts are symbols, line items are calls.

Table sizes enter as literals (a row count from Parquet footers), not as scalar joins, so that Catalyst sees plain
expressions.  SQL of the same mapping, for the oracle, stands beside each relation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import Store
from ..operators.index import Index


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


PLAIN_NAME = "concat(CASE WHEN p_partkey % 11 = 0 THEN '_' ELSE '' END, replace(p_name, ' ', '_'), '_', p_partkey % 97)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS file_id",
        "CASE WHEN s_suppkey % 10 = 0 THEN concat('mod_', s_suppkey, '.py') ELSE concat('pkg', s_nationkey, '/mod_', s_suppkey, '.py') END AS rel_path",
        "sha2(s_name, 256) AS file_hash",
        "CASE WHEN s_suppkey % 5 = 0 THEN 'go' WHEN s_suppkey % 7 = 0 THEN 'rust' ELSE 'python' END AS language",
        "CAST(100 + s_suppkey % 400 AS int) AS line_count",
        "CASE WHEN s_suppkey % 17 = 0 THEN concat('line ', s_suppkey) END AS parse_error",
    )


FILES = """files AS (SELECT s_suppkey AS file_id,
  CASE WHEN s_suppkey % 10 = 0 THEN concat('mod_', s_suppkey, '.py') ELSE concat('pkg', s_nationkey, '/mod_', s_suppkey, '.py') END AS rel_path,
  sha256(s_name) AS file_hash, CASE WHEN s_suppkey % 5 = 0 THEN 'go' WHEN s_suppkey % 7 = 0 THEN 'rust' ELSE 'python' END AS language,
  CAST(100 + s_suppkey % 400 AS int) AS line_count, CASE WHEN s_suppkey % 17 = 0 THEN concat('line ', s_suppkey) END AS parse_error FROM supplier)"""


def symbols(spark: SparkSession, sf_dir: str, n_files: int) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS symbol_id",
        f"p_partkey % {n_files} AS file_id",
        f"CASE WHEN p_partkey >= {n_files} AND p_partkey % 3 <> 0 THEN p_partkey % {n_files} END AS parent_id",
        f"CASE WHEN p_partkey < {n_files} THEN 'class' WHEN p_partkey % 3 = 0 THEN 'function' ELSE 'method' END AS kind",
        f"{PLAIN_NAME} || CASE WHEN p_partkey % 9 = 4 THEN '_idle' ELSE '' END AS name",
        """concat('[{"name":"', p_brand, '","type":"', p_type, '"},{"name":"n","default":"', p_size, '"}]') AS params_json""",
        "p_type AS return_type",
        """CASE WHEN p_partkey % 13 = 0 THEN '["property"]' ELSE '[]' END AS decorators_json""",
        "'[]' AS bases_json",
        "CASE WHEN p_partkey % 4 <> 0 THEN concat(p_type, ' ', p_brand) END AS docstring",
        "CAST(p_size * 10 AS int) AS line_start",
        "CAST(p_size * 10 + p_partkey % 70 AS int) AS line_end",
        "CAST(p_partkey % 23 AS int) AS complexity",
        "CAST(p_partkey % 2 AS int) AS is_async",
    )


SYMBOLS = """symbols AS (SELECT p_partkey AS symbol_id, p_partkey % nf AS file_id, CASE WHEN p_partkey >= nf AND p_partkey % 3 <> 0 THEN p_partkey % nf END AS parent_id,
  CASE WHEN p_partkey < nf THEN 'class' WHEN p_partkey % 3 = 0 THEN 'function' ELSE 'method' END AS kind,
  concat(CASE WHEN p_partkey % 11 = 0 THEN '_' ELSE '' END, replace(p_name, ' ', '_'), '_', p_partkey % 97, CASE WHEN p_partkey % 9 = 4 THEN '_idle' ELSE '' END) AS name,
  concat('[{"name":"', p_brand, '","type":"', p_type, '"},{"name":"n","default":"', p_size, '"}]') AS params_json, p_type AS return_type,
  CASE WHEN p_partkey % 13 = 0 THEN '["property"]' ELSE '[]' END AS decorators_json, CASE WHEN p_partkey % 4 <> 0 THEN concat(p_type, ' ', p_brand) END AS docstring,
  CAST(p_size * 10 AS int) AS line_start, CAST(p_size * 10 + p_partkey % 70 AS int) AS line_end, CAST(p_partkey % 23 AS int) AS complexity, CAST(p_partkey % 2 AS int) AS is_async
  FROM part, (SELECT count(*) AS nf FROM supplier))"""


def calls(spark: SparkSession, sf_dir: str, n_parts: int) -> DataFrame:
    """Every line item is a call.  No call names an idle symbol, so some symbols are dead at any density; some names are called
    in capitals always or at times, which only LIKE would match."""
    names = read(spark, sf_dir, "part").selectExpr("p_partkey AS target", f"{PLAIN_NAME} AS target_name")
    return read(spark, sf_dir, "lineitem").withColumn("target", F.col("l_orderkey") % n_parts).join(names, "target").selectExpr(
        "l_orderkey * 10 + l_linenumber AS call_id",
        "l_suppkey AS file_id",
        "CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS caller_id",
        "concat(CASE l_returnflag WHEN 'A' THEN 'self.' WHEN 'N' THEN 'obj.attr.' ELSE '' END, CASE WHEN target % 41 = 5 OR target % 41 = 7 AND l_linenumber = 3 THEN upper(target_name) ELSE target_name END) AS callee_expr",
        "CAST(l_linenumber AS int) AS line_no",
    )


CALLS = """calls AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey AS file_id, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS caller_id,
  concat(CASE l_returnflag WHEN 'A' THEN 'self.' WHEN 'N' THEN 'obj.attr.' ELSE '' END, CASE WHEN p.p_partkey % 41 = 5 OR p.p_partkey % 41 = 7 AND l_linenumber = 3 THEN upper(target_name) ELSE target_name END) AS callee_expr, CAST(l_linenumber AS int) AS line_no
  FROM lineitem JOIN (SELECT count(*) AS np FROM part) ON true JOIN (SELECT *, concat(CASE WHEN p_partkey % 11 = 0 THEN '_' ELSE '' END, replace(p_name, ' ', '_'), '_', p_partkey % 97) AS target_name FROM part) p ON p.p_partkey = l_orderkey % np)"""


def imports(spark: SparkSession, sf_dir: str, n_files: int) -> DataFrame:
    """Every customer is an import: mostly of a file some places on, one in 311 of a file some places back."""
    src, step = f"(1 + c_custkey % {n_files})", "(1 + (c_nationkey * 7 + c_custkey) % 23)"
    made = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS import_id", f"{src} AS file_id", f"CASE WHEN c_custkey % 311 = 0 THEN greatest(1, {src} - {step}) ELSE least({n_files}, {src} + {step}) END AS target",
        "CAST(c_custkey % 2 AS int) AS is_from", "CAST(1 + c_custkey % 7 AS int) AS line_no",
    )
    named = files(spark, sf_dir).selectExpr("file_id AS target", "replace(replace(rel_path, '/', '.'), '.py', '') AS module")
    return made.join(named, "target").selectExpr("import_id", "file_id", "module", "CAST(NULL AS string) AS name", "CAST(NULL AS string) AS alias", "is_from", "line_no")


IMPORTS = """imports AS (SELECT c_custkey AS import_id, c.file_id, replace(replace(f.rel_path, '/', '.'), '.py', '') AS module, CAST(NULL AS varchar) AS name, CAST(c_custkey % 2 AS int) AS is_from, CAST(1 + c_custkey % 7 AS int) AS line_no
  FROM (SELECT c_custkey, src AS file_id, CASE WHEN c_custkey % 311 = 0 THEN greatest(1, src - step) ELSE least(nf, src + step) END AS target
    FROM (SELECT c_custkey, nf, 1 + c_custkey % nf AS src, 1 + (c_nationkey * 7 + c_custkey) % 23 AS step FROM customer, (SELECT count(*) AS nf FROM supplier))) c JOIN files f ON f.file_id = c.target)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS ref_id", "l_suppkey AS file_id", "l_partkey AS symbol_id", "'read' AS ref_kind",
        "concat('self.', l_returnflag, '_', l_linestatus) AS target", "concat(l_returnflag, '_', l_linestatus) AS name", "CAST(l_linenumber AS int) AS line_no",
    )


REFS = """refs AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, l_suppkey AS file_id, l_partkey AS symbol_id, 'read' AS ref_kind, concat('self.', l_returnflag, '_', l_linestatus) AS target,
  concat(l_returnflag, '_', l_linestatus) AS name, CAST(l_linenumber AS int) AS line_no FROM lineitem)"""


def diagnostics(spark: SparkSession, sf_dir: str, n_files: int) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS diag_id", f"o_orderkey % {n_files} AS file_id", "o_orderpriority AS rule_id", "CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'info' END AS severity",
        "concat('order ', o_orderkey) AS message", "CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_custkey % 100 AS int) END AS line_no", "CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS is_resolved",
    )


DIAGNOSTICS = """diagnostics AS (SELECT o_orderkey AS diag_id, o_orderkey % nf AS file_id, o_orderpriority AS rule_id, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'info' END AS severity,
  concat('order ', o_orderkey) AS message, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_custkey % 100 AS int) END AS line_no, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS is_resolved
  FROM orders, (SELECT count(*) AS nf FROM supplier))"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits that touch the suppliers of their line items."""
    paths = files(spark, sf_dir).select(F.col("file_id").alias("l_suppkey"), "rel_path")
    touched = read(spark, sf_dir, "lineitem").join(paths, "l_suppkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("rel_path")).alias("files"))
    return read(spark, sf_dir, "orders").join(touched, "o_orderkey").selectExpr("concat('c', o_orderkey) AS commit", "concat('a', o_custkey) AS author", "CAST(unix_seconds(CAST(o_orderdate AS timestamp)) AS long) AS at", "o_orderpriority AS subject", "files")


COMMITS = """commits AS (SELECT concat('c', o_orderkey) AS "commit", concat('a', o_custkey) AS author, CAST(epoch(o_orderdate) AS bigint) AS "at", o_orderpriority AS subject, t.files
  FROM orders JOIN (SELECT l_orderkey, list_sort(list_distinct(list(rel_path))) AS files FROM lineitem JOIN files ON file_id = l_suppkey GROUP BY l_orderkey) t ON t.l_orderkey = o_orderkey)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the change log: a user is a session."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS change_id", "user_id AS session_id", "CAST(event_id % 100 AS string) AS rel_path",
        "CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type", "ts AS changed_at", "props",
    )


CHANGES = """changes AS (SELECT event_id AS change_id, user_id AS session_id, CAST(event_id % 100 AS varchar) AS rel_path,
  CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, ts AS changed_at, props FROM events)"""

_VIEWS = {"files": ((), FILES), "symbols": ((), SYMBOLS), "calls": ((), CALLS), "imports": (("files",), IMPORTS), "refs": ((), REFS), "diagnostics": ((), DIAGNOSTICS), "commits": (("files",), COMMITS), "changes": ((), CHANGES)}


def oracle(body: str, *views: str) -> str:
    """SQL of a query over the named relations, for the driver's tables."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in _VIEWS[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for view in views:
        add(view)
    ctes = ",\n".join(_VIEWS[v][1] for v in needed)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


_SIZES: dict[tuple[str, str, str], int] = {}


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """A table's row count, asked once per application: the driver's tables do not change."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SIZES:
        _SIZES[key] = read(spark, sf_dir, name).count()
    return _SIZES[key]


_STORES: dict[tuple[str, str, str], Store] = {}


def stored(spark: SparkSession, sf_dir: str, what: str, build: Callable[[Store], None]) -> Store:
    """A store over the driver's tables, built once per application in the folder that driver and executors share."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _STORES:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        store = Store(spark, f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}")
        build(store)
        _STORES[key] = store
    return _STORES[key]


def index(spark: SparkSession, sf_dir: str) -> Index:
    n_files, n_parts = rows_of(spark, sf_dir, "supplier"), rows_of(spark, sf_dir, "part")
    return Index(files(spark, sf_dir), symbols(spark, sf_dir, n_files), calls(spark, sf_dir, n_parts), refs(spark, sf_dir), imports(spark, sf_dir, n_files), diagnostics(spark, sf_dir, n_files))
