"""What a change of a symbol reaches: its callers, and theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import Index
from .lookup import SITE, callers, callers_of_each, class_callers


def _second_hop(ix: Index, direct: DataFrame, also_known: DataFrame, hop_limit: int) -> DataFrame:
    """Callers of the direct callers, but for callers that are known already.  Sites outside any symbol (no caller name)
    are always kept: the exclusion is an anti join, which nulls pass."""
    names = direct.where("caller_name is not null").select(F.col("caller_name").alias("seed")).distinct()
    known = names.select(F.col("seed").alias("caller_name")).unionByName(also_known).distinct()
    return callers_of_each(ix, names, hop_limit).join(known, "caller_name", "left_anti").select("seed", "rank", *SITE)


def direct_callers(ix: Index, name: str, limit: int = 50) -> DataFrame:
    return callers(ix, name, limit)


def transitive_callers(ix: Index, name: str, limit: int = 50, hop_limit: int = 20) -> DataFrame:
    own = ix.spark.range(1).select(F.lit(name).alias("caller_name"))
    return _second_hop(ix, callers(ix, name, limit), own, hop_limit).orderBy("seed", "rank")


def class_direct(ix: Index, class_id: int, class_name: str, limit: int = 50) -> DataFrame:
    return class_callers(ix, class_id, class_name, limit, ("method", "function"))


def class_transitive(ix: Index, class_id: int, class_name: str, limit: int = 50, hop_limit: int = 20) -> DataFrame:
    """Second-hop callers of a class, one row per (caller, file, line), none of them a direct site or a member."""
    direct = class_direct(ix, class_id, class_name, limit)
    own = ix.symbols.where(F.col("parent_id") == class_id).select(F.col("name").alias("caller_name"))
    own = own.unionByName(ix.spark.range(1).select(F.lit(class_name).alias("caller_name")))
    key = [F.coalesce("caller_name", F.lit("")).alias("caller_key"), "rel_path", "line_no"]
    second = _second_hop(ix, direct, own, hop_limit).select("*", key[0]).join(direct.select(*key), ["caller_key", "rel_path", "line_no"], "left_anti")
    first = F.row_number().over(Window.partitionBy("caller_key", "rel_path", "line_no").orderBy("seed", "rank"))
    return second.withColumn("k", first).where("k = 1").select("seed", "rank", *SITE).orderBy("seed", "rank")


def files_affected(direct: DataFrame, transitive: DataFrame) -> DataFrame:
    return direct.select("rel_path").union(transitive.select("rel_path")).distinct().orderBy("rel_path")


def score(direct: DataFrame, transitive: DataFrame) -> DataFrame:
    """n_direct, n_transitive, score: a direct caller weighs one, a second-hop caller a half."""
    a = direct.agg(F.count("*").alias("n_direct"))
    b = transitive.agg(F.count("*").alias("n_transitive"))
    return a.crossJoin(b).withColumn("score", F.col("n_direct") + F.col("n_transitive") * 0.5)  # one row each


def by_member(direct: DataFrame) -> DataFrame:
    return direct.groupBy("via_member").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rel_path", F.col("line_no").cast("string")))), ",").alias("sites"))


def reach(ix: Index, name: str, hops: int = 3) -> DataFrame:
    """(name, hop): every caller within so many hops, at its first hop; a bounded walk over distinct names."""
    edges = ix.call_sites().where("caller_name is not null").select(F.col("callee_last").alias("name"), "caller_name").distinct()
    found = frontier = ix.spark.range(1).select(F.lit(name).alias("name"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        frontier = edges.join(frontier.select("name"), "name").select(F.col("caller_name").alias("name")).distinct().join(found.select("name"), "name", "left_anti").withColumn("hop", F.lit(hop))
        found = found.unionByName(frontier)
    return found


def impact(ix: Index, name: str) -> dict:
    """Direct and transitive callers (the first 30 of these), affected files and score; of a class, by member."""
    row = ix.symbols.where((F.col("name") == name) & (F.col("kind") == "class")).orderBy("symbol_id").first()
    if row is None:
        direct, second = direct_callers(ix, name), transitive_callers(ix, name)
        return {"symbol": name, "direct": direct, "transitive": second.limit(30), "files": files_affected(direct, second), "score": score(direct, second)}
    direct, second = class_direct(ix, row["symbol_id"], name), class_transitive(ix, row["symbol_id"], name)
    own = ix.symbols.where((F.col("parent_id") == row["symbol_id"]) & F.col("kind").isin("method", "function"))
    return {
        "symbol": name, "kind": "class", "members": own.select("name").orderBy("name"), "direct": direct, "by_member": by_member(direct),
        "transitive": second.limit(30), "files": files_affected(direct, second), "score": score(direct, second),
    }
