"""Rules over the index: three native ones, and user rules in SQL; findings, runs and ratings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException, ParseException

from ..functions import text
from ..functions.dialect import RuleSqlError, to_spark_sql
from .index import Index


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    sql: str | None = None
    severity: str = "warning"
    description: str = ""
    is_builtin: int = 0
    enabled: int = 1
    weight: float = 1.0
    learned_from: str | None = None


#: Ids, names and descriptions that findings are reported under.
BUILTIN = [
    Rule("DEAD_SYMBOL", "Dead symbol", None, "info", "Symbol never referenced in any call site", 1),
    Rule("LARGE_SYMBOL", "Large symbol", None, "warning", "Function/method exceeds 50 lines or complexity > 15", 1),
    Rule("CIRCULAR_IMPORT", "Circular import", None, "warning", "Module A imports B and B imports A", 1),
]


def dead_symbols(ix: Index, compat: bool = False) -> DataFrame:
    """Functions and methods that nothing calls by name and that call nothing; private names and properties left out.

    "Called by name" is an equi anti join on the last segment of the call expression.  compat adds names that match in
    another letter case (an equi join too) as LIKE would.
    """
    candidates = ix.symbols.where(F.col("kind").isin("function", "method") & ~F.col("name").startswith("_"))
    decorators = F.coalesce("decorators_json", F.lit("[]"))
    candidates = candidates.where(~decorators.ilike("%property%") & ~decorators.ilike("%.setter%"))
    called = ix.calls.select(text.last_segment(F.col("callee_expr")).alias("name")).distinct()
    silent = candidates.join(ix.calls.where("caller_id is not null").select(F.col("caller_id").alias("symbol_id")), "symbol_id", "left_anti")
    found = silent.join(called, "name", "left_anti")
    if compat:
        dotted = ix.calls.where(F.contains("callee_expr", F.lit("."))).select(F.lower(text.last_segment(F.col("callee_expr"))).alias("low")).distinct()
        found = found.withColumn("low", F.lower("name")).join(dotted, "low", "left_anti").drop("low")
    return found.join(ix.files.select("file_id", "rel_path"), "file_id").select("symbol_id", "name", "kind", "line_start", "rel_path", "file_id")


def large_symbols(ix: Index, max_lines: int = 50, max_complexity: int = 15) -> DataFrame:
    big = F.col("kind").isin("function", "method") & ((F.col("line_end") - F.col("line_start") > max_lines) | (F.col("complexity") > max_complexity))
    return ix.located_symbols().where(big).select("symbol_id", "name", "kind", "line_start", "line_end", "complexity", "rel_path", "file_id", "parent_name")


def circular_imports(ix: Index, compat: bool = False) -> DataFrame:
    """Pairs of files that import each other, by two equi joins on the module key."""
    key = text.module_key_compat if compat else text.module_key
    files = ix.files.select("file_id", "rel_path", key(F.col("rel_path")).alias("module"))
    edges = ix.imports.select("file_id", "module").distinct()
    named = edges.join(files.select("file_id", F.col("rel_path").alias("file_a"), F.col("module").alias("module_a")), "file_id")
    onward = named.join(files.select(F.col("rel_path").alias("file_b"), F.col("file_id").alias("file_id_b"), "module"), "module")
    back = edges.select(F.col("file_id").alias("file_id_b"), F.col("module").alias("module_a"))
    return onward.join(back, ["file_id_b", "module_a"]).where("file_a < file_b").select("file_a", "file_id", "file_b", F.col("module").alias("a_imports")).distinct()


def import_cycles(ix: Index) -> DataFrame:
    """(rel_path): files on an import cycle of any length.

    Files without an importer or an import left are trimmed until none is.  Then each file takes the largest id that
    reaches it, and the files of that color from which its owner is reached are the owner's strong component.  These are
    cut out, and the rest goes again.  Steps are joins over distinct edges, written to the checkpoint folder.
    """
    files = ix.files.select("file_id", text.module_key(F.col("rel_path")).alias("module"))
    edges = ix.imports.join(files.select(F.col("file_id").alias("dst"), "module"), "module").select(F.col("file_id").alias("src"), "dst").where("src <> dst").distinct()
    edges, cyclic = edges.checkpoint(), []
    while left := _trimmed(edges):
        edges = left
        colors = _colors(edges)
        alike = edges.join(colors.select(F.col("file_id").alias("src"), "color"), "src").join(colors.select(F.col("file_id").alias("dst"), F.col("color").alias("other")), "dst").where("color = other").select("src", "dst").checkpoint()
        found = frontier = colors.where("file_id = color").select("file_id").checkpoint()
        while not frontier.isEmpty():
            frontier = alike.join(frontier.withColumnRenamed("file_id", "dst"), "dst").select(F.col("src").alias("file_id")).distinct().join(found, "file_id", "left_anti").checkpoint()
            found = found.unionByName(frontier).checkpoint()
        cyclic.append(alike.join(found.withColumnRenamed("file_id", "src"), "src", "left_semi").join(found.withColumnRenamed("file_id", "dst"), "dst", "left_semi").select(F.col("src").alias("file_id")))
        edges = edges.join(found.withColumnRenamed("file_id", "src"), "src", "left_anti").join(found.withColumnRenamed("file_id", "dst"), "dst", "left_anti").checkpoint()
    on = reduce(DataFrame.unionByName, cyclic, edges.select(F.col("src").alias("file_id")).limit(0))
    return on.distinct().join(ix.files, "file_id").select("rel_path").orderBy("rel_path")


def _trimmed(edges: DataFrame) -> DataFrame | None:
    """edges without those that no cycle can hold for lack of a way in or out; None if none is left."""
    n, last = edges.count(), None
    while n and n != last:
        sources, targets = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = edges.join(targets, "src", "left_semi").join(sources, "dst", "left_semi").select("src", "dst").checkpoint()
        n, last = edges.count(), n
    return edges if n else None


def _colors(edges: DataFrame) -> DataFrame:
    """(file_id, color): the largest id from which each file is reached, its own included."""
    colors = edges.select(F.col("src").alias("file_id")).union(edges.select("dst")).distinct().withColumn("color", F.col("file_id")).checkpoint()
    while True:
        sent = edges.join(colors.withColumnRenamed("file_id", "src"), "src").groupBy(F.col("dst").alias("file_id")).agg(F.max("color").alias("sent"))
        after = colors.join(sent, "file_id", "left").select("file_id", F.greatest("color", "sent").alias("color"), (F.col("sent") > F.col("color")).alias("moved")).checkpoint()
        colors = after.select("file_id", "color")
        if after.where("moved").isEmpty():
            return colors


NATIVE = {"DEAD_SYMBOL": dead_symbols, "LARGE_SYMBOL": large_symbols, "CIRCULAR_IMPORT": circular_imports}


def query_sql(ix: Index, sql: str) -> DataFrame:
    """A user's SELECT over the index; anything but one reading statement is refused."""
    statement = to_spark_sql(sql)
    with ix.registered():
        return ix.spark.sql(statement)


def try_rule(ix: Index, sql: str, rows: int = 50) -> list[dict]:
    """The first rows of a rule, or one row that says what is wrong with it."""
    try:
        return [r.asDict() for r in query_sql(ix, sql).limit(rows).collect()]
    except (RuleSqlError, AnalysisException, ParseException) as e:
        return [{"error": str(e).splitlines()[0]}]


def _column(rows: DataFrame, kind: str, *names: str) -> Column:
    """The first non-null of the columns that the rule's result has."""
    present = [F.col(n).cast(kind) for n in names if n in rows.columns]
    return F.coalesce(*present) if present else F.lit(None).cast(kind)


def message(rule: Rule, rows: DataFrame) -> Column:
    name = text.qualified(_column(rows, "string", "parent_name"), F.coalesce(_column(rows, "string", "name"), F.lit("")))
    if rule.rule_id == "DEAD_SYMBOL":
        return F.concat(name, F.lit(" ("), F.coalesce(_column(rows, "string", "kind"), F.lit("")), F.lit(") -- never called"))
    if rule.rule_id == "LARGE_SYMBOL":
        lines, complexity = _column(rows, "int", "line_end") - _column(rows, "int", "line_start"), _column(rows, "int", "complexity")
        parts = F.concat_ws(", ", F.when(lines > 50, F.concat(lines.cast("string"), F.lit(" lines"))), F.when(complexity > 15, F.concat(F.lit("complexity "), complexity.cast("string"))))
        return F.concat(name, F.lit(": "), parts)
    if rule.rule_id == "CIRCULAR_IMPORT":
        return F.concat(F.lit("Circular import: "), _column(rows, "string", "file_a"), F.lit(" <-> "), _column(rows, "string", "file_b"))
    return F.when(name == "", F.lit(rule.name)).otherwise(F.concat(F.lit(f"{rule.name}: "), name))


def findings(ix: Index, rule: Rule, now: datetime | None = None) -> DataFrame:
    """A rule's findings in the columns of diagnostics (without an id); rows without a file are dropped."""
    rows = NATIVE[rule.rule_id](ix) if rule.sql is None else query_sql(ix, rule.sql)
    if "file_id" not in rows.columns:
        rows = rows.withColumn("file_id", F.lit(None).cast("long"))
    at = F.lit(now or datetime.now()).cast("timestamp_ntz")
    return rows.where("file_id is not null").select(
        F.col("file_id").cast("long").alias("file_id"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), message(rule, rows).alias("message"),
        _column(rows, "int", "line_start", "line_no").alias("line_no"), _column(rows, "string", "rel_path").alias("context"), F.lit(0).alias("is_resolved"), at.alias("first_seen"), at.alias("last_seen"),
    )


def run_rules(ix: Index, rules: list[Rule], now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, runs) of all enabled rules: one union, counted by rule.  A rule that fails has neither."""
    parts, ran = [], []
    for rule in rules:
        if rule.enabled:
            try:
                parts.append(findings(ix, rule, now))
                ran.append(rule.rule_id)
            except (RuleSqlError, AnalysisException, ParseException):
                continue
    spark: SparkSession = ix.spark
    if not parts:
        empty = findings(ix, BUILTIN[1], now).limit(0)
        return empty, empty.groupBy("rule_id").agg(F.count("*").alias("findings_count"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    listed = spark.createDataFrame([(r,) for r in ran], "rule_id string")
    runs = listed.join(found.groupBy("rule_id").agg(F.count("*").alias("n")), "rule_id", "left")
    return found, runs.select("rule_id", F.coalesce("n", F.lit(0)).cast("int").alias("findings_count"))


def replace_findings(old: DataFrame, new: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Findings after some rules ran again: theirs replaced, the others kept."""
    return old.where(~F.col("rule_id").isin(rule_ids)).select(*new.columns).unionByName(new)


def list_findings(
    diagnostics: DataFrame, files: DataFrame, severity: str | None = None, rule_id: str | None = None, file_pattern: str | None = None, exclude_pattern: str | None = None, limit: int = 100
) -> DataFrame:
    """Open findings, errors before warnings before the rest, then by path and line (no line first)."""
    found = diagnostics.where("is_resolved = 0").join(files.select("file_id", "rel_path"), "file_id")
    for column, value in (("severity", severity), ("rule_id", rule_id)):
        if value:
            found = found.where(F.col(column) == value)
    if file_pattern:
        found = found.where(text.contains_like(F.col("rel_path"), file_pattern))
    if exclude_pattern:
        found = found.where(~text.contains_like(F.col("rel_path"), exclude_pattern))
    urgency = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return found.orderBy(urgency, "rel_path", "line_no", "rule_id", "message").limit(limit).select("rel_path", "rule_id", "severity", "message", "line_no")


def effectiveness(rules: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs, findings and useful findings of every rule, the most useful first."""
    sums = runs.groupBy("rule_id").agg(F.count("run_id").alias("runs"), F.sum("findings_count").alias("f"), F.sum("useful_count").alias("u"))
    joined = rules.select("rule_id", "name").join(sums, "rule_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("rule_id", "name", zero("runs").alias("runs"), zero("f").alias("total_findings"), zero("u").alias("total_useful")).orderBy(F.desc("total_useful"), F.desc("total_findings"), "rule_id")


def rate(runs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Runs with ratings (rule_id, useful 1 or 0) applied: plus or minus one each, to the latest run of the rule."""
    change = ratings.groupBy("rule_id").agg(F.sum(F.when(F.col("useful") == 1, 1).otherwise(-1)).alias("change"))
    latest = runs.groupBy("rule_id").agg(F.max("run_id").alias("run_id"))
    moved = latest.join(change, "rule_id").select("run_id", "change")
    return runs.join(moved, "run_id", "left").withColumn("useful_count", F.coalesce("useful_count", F.lit(0)) + F.coalesce("change", F.lit(0))).select(*runs.columns)
