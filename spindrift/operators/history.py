"""Snapshots and structural diffs, change detection, sessions, annotations, knowledge, and commit history."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import SCHEMAS
from .catalog import numbered
from .impact import direct_callers, transitive_callers
from .index import Index

# -- snapshots and diffs ------------------------------------------------------------------------------------------------


def symbol_state(ix: Index) -> DataFrame:
    """Symbols as a diff compares them: n name, k kind, f file, ls and le lines, p parent."""
    return ix.located_symbols().select(F.col("name").alias("n"), F.col("kind").alias("k"), F.col("rel_path").alias("f"), F.col("line_start").alias("ls"), F.col("line_end").alias("le"), F.col("parent_name").alias("p"))


def call_state(ix: Index) -> DataFrame:
    """Calls as a diff compares them: cr caller, ce expression, f file, l line."""
    return ix.call_sites().select(F.col("caller_name").alias("cr"), F.col("callee_expr").alias("ce"), F.col("rel_path").alias("f"), F.col("line_no").alias("l"))


#: Buckets of a state, by the hash of what a diff matches rows by; so each bucket can be compared by itself.
STATE_BUCKETS = 16
STATE_KEYS = {"snapshot_symbols": ("p", "n"), "snapshot_calls": ("cr", "ce")}


def bucketed(what: str, state: DataFrame) -> DataFrame:
    key = [text.qualified(F.col("p"), F.col("n"))] if what == "snapshot_symbols" else [F.col(c) for c in STATE_KEYS[what]]
    return state.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(STATE_BUCKETS)).cast("int"))


def state_digests(states: dict[str, DataFrame]) -> DataFrame:
    """(what, bucket, digest) of bucketed states: a sum over row hashes, whatever their order."""
    out = None
    for what, df in states.items():
        row = F.xxhash64(*[c for c in df.columns if c != "bucket"]).cast("decimal(38,0)")
        part = df.groupBy("bucket").agg(F.concat_ws(":", F.count("*"), F.sum(row)).alias("digest")).select(F.lit(what).alias("what"), "bucket", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def snapshot_name(now: datetime) -> str:
    return f"snapshot_{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"


def keep_newest(snapshots: DataFrame, keep: int = 20) -> DataFrame:
    kept = snapshots.select("snapshot_id", "created_at").orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(keep)  # the best of each task meet
    return snapshots.join(kept.select("snapshot_id"), "snapshot_id", "left_semi")


def _keyed(symbols: DataFrame) -> DataFrame:
    """One row per qualified name: of several, the last by file and line."""
    named = symbols.withColumn("key", text.qualified(F.col("p"), F.col("n")))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("f"), F.desc("ls"), F.desc("k"), F.desc("le")))
    return named.withColumn("rank", rank).where("rank = 1").drop("rank")


def _edges(calls: DataFrame) -> DataFrame:
    """One row per (caller, expression): of several, the first by file and line; only with a caller."""
    rank = F.row_number().over(Window.partitionBy("cr", "ce").orderBy("f", "l"))
    return calls.where("cr is not null and cr <> ''").withColumn("rank", rank).where("rank = 1").drop("rank")


def symbols_added(old: DataFrame, new: DataFrame) -> DataFrame:
    return _keyed(new).join(_keyed(old).select("key"), "key", "left_anti").select("key", F.col("n").alias("name"), F.col("k").alias("kind"), F.col("f").alias("rel_path"), F.col("ls").alias("line_start"))


def symbols_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return symbols_added(new, old)


def symbols_modified(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names on both sides whose file or kind differs."""
    a = _keyed(old).select("key", F.col("f").alias("old_file"), F.col("ls").alias("old_line"), F.col("k").alias("old_kind"))
    b = _keyed(new).select("key", F.col("n").alias("name"), F.col("f").alias("new_file"), F.col("ls").alias("new_line"), F.col("k").alias("new_kind"))
    both = a.join(b, "key").where("old_file <> new_file or old_kind <> new_kind")
    return both.select("key", "name", "old_file", "old_line", "new_file", "new_line", (F.col("old_kind") != F.col("new_kind")).cast("int").alias("kind_changed"))


def calls_added(old: DataFrame, new: DataFrame) -> DataFrame:
    found = _edges(new).join(_edges(old).select("cr", "ce"), ["cr", "ce"], "left_anti")
    return found.select(F.col("cr").alias("caller"), F.col("ce").alias("callee"), F.col("f").alias("rel_path"), F.col("l").alias("line_no"))


def calls_broken(old: DataFrame, new: DataFrame, new_symbols: DataFrame) -> DataFrame:
    """Calls that are gone while their caller is still there; says whether the callee still is."""
    names = new_symbols.select("n").distinct()
    gone = calls_added(new, old).join(names.select(F.col("n").alias("caller")), "caller", "left_semi")
    there = names.select(F.col("n").alias("last"), F.lit(1).alias("there"))
    return gone.withColumn("last", text.last_segment(F.col("callee"))).join(there, "last", "left").select("caller", "callee", "rel_path", "line_no", F.coalesce("there", F.lit(0)).alias("callee_still_exists"))


def diff(old_symbols: DataFrame, old_calls: DataFrame, new_symbols: DataFrame, new_calls: DataFrame, names: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five kinds of structural change, the files they touch, and their counts.

    Of both sides all buckets that are equal may be left out; names then has all new symbols, for calls that broke.
    """
    out = {
        "symbols_added": symbols_added(old_symbols, new_symbols), "symbols_removed": symbols_removed(old_symbols, new_symbols), "symbols_modified": symbols_modified(old_symbols, new_symbols),
        "calls_broken": calls_broken(old_calls, new_calls, new_symbols if names is None else names), "calls_added": calls_added(old_calls, new_calls),
    }
    touched = out["symbols_added"].select("rel_path").union(out["symbols_removed"].select("rel_path"))
    touched = touched.union(out["symbols_modified"].select(F.explode(F.array("old_file", "new_file"))))
    out["files_changed"] = touched.where("rel_path is not null and rel_path <> ''").distinct()
    counts = None
    for name, df in list(out.items()):
        row = df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        counts = row if counts is None else counts.unionByName(row)
    return out | {"summary": counts}


def state_with_files(current: DataFrame, parsed: DataFrame, changed: list[str]) -> DataFrame:
    """An earlier state: rows parsed from the earlier text of changed files, and current rows of all others."""
    return current.where(~F.col("f").isin(changed)).unionByName(parsed)


# -- changes and sessions -----------------------------------------------------------------------------------------------


def detect_changes(indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(rel_path, change_type, old_hash, new_hash): one full outer join by path."""
    a = indexed.select("rel_path", F.col("file_hash").alias("old_hash"))
    b = on_disk.select("rel_path", F.col("file_hash").alias("new_hash"))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return a.join(b, "rel_path", "full_outer").withColumn("change_type", kind).where("change_type is not null").select("rel_path", "change_type", "old_hash", "new_hash")


def change_counts(changes: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("change_type") == kind)
    return changes.agg(n("modified").alias("changed"), n("added").alias("added"), n("deleted").alias("removed"))


def record_changes(changes: DataFrame, session_id: int, now: datetime) -> DataFrame:
    """Rows of change_log without ids; changes are kept by path, so that new files have theirs."""
    return changes.select(F.lit(session_id).cast("long").alias("session_id"), "rel_path", "change_type", "old_hash", "new_hash", F.lit(now).cast("timestamp_ntz").alias("changed_at"))


AUTO_END = "Auto-ended by new session"


def session_state(events: DataFrame) -> DataFrame:
    """Sessions folded from their events (session_id, event start or end, at, transcript_path, summary).

    A session that has no end of its own ends when the next one starts, with a fixed summary.
    """
    started = events.where("event = 'start'").groupBy("session_id").agg(F.min("at").alias("started_at"), F.max("transcript_path").alias("transcript_path"))
    ended = events.where("event = 'end'").groupBy("session_id").agg(F.max("at").alias("own_end"), F.max_by("summary", "at").alias("own_summary"))
    # Sessions of all users may be many: each finds the next by its number in sorted ranges, not in one window.
    ranked = numbered(started, "k", "started_at", "session_id")
    following = ranked.select((F.col("k") - 1).alias("k"), F.col("started_at").alias("next_start"))
    joined = ranked.join(following, "k", "left").drop("k").join(ended, "session_id", "left")
    cut = F.col("own_end").isNull() & F.col("next_start").isNotNull()
    return joined.select("session_id", "started_at", F.coalesce("own_end", "next_start").alias("ended_at"), "transcript_path", F.when(cut, F.lit(AUTO_END)).otherwise(F.col("own_summary")).alias("summary"))


def active_session(sessions: DataFrame) -> DataFrame:
    return sessions.where("ended_at is null").orderBy(F.desc("session_id")).limit(1)


def session_history(sessions: DataFrame, changes: DataFrame, limit: int = 10) -> DataFrame:
    """The latest sessions with the number of changes of each."""
    latest = sessions.orderBy(F.desc("session_id")).limit(limit)
    counts = changes.groupBy("session_id").agg(F.count("*").alias("n"))
    return latest.join(counts, "session_id", "left").withColumn("changes", F.coalesce("n", F.lit(0))).drop("n").orderBy(F.desc("session_id"))


# -- annotations and knowledge ------------------------------------------------------------------------------------------


def attach_annotations(annotations: DataFrame, ix: Index) -> DataFrame:
    """Annotations with the present ids of what they are about: notes outlive a new index, as they are kept by path and name."""
    files = ix.files.select("rel_path", "file_id")
    symbols = ix.located_symbols().groupBy("rel_path", "qualified_name").agg(F.min("symbol_id").alias("symbol_id"))
    return annotations.join(files, "rel_path", "left").join(symbols, ["rel_path", "qualified_name"], "left")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """old with the rows of new in place of those of equal keys; columns in ``keep`` stay as old has them."""
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep], F.lit(1).alias("__old"))
        held = {c: F.when(F.col("__old") == 1, F.col(f"__{c}")).otherwise(F.col(c)) for c in keep}
        new = new.join(before, keys, "left").withColumns(held).select(*old.columns)
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def set_knowledge(knowledge: DataFrame, key: str, value, now: datetime) -> DataFrame:
    row = knowledge.sparkSession.createDataFrame([(key, json.dumps(value), now)], SCHEMAS["knowledge"])
    return upsert(knowledge, row, ["key"])


def get_knowledge(knowledge: DataFrame, key: str):
    row = knowledge.where(F.col("key") == key).select("value_json").first()
    return json.loads(row[0]) if row else None


# -- commits (commit, author, at, subject, files array<string>) ------------------------------------------------------------


def recent_commits(commits: DataFrame, limit: int = 50, since: str | None = None, paths: list[str] | None = None) -> DataFrame:
    if since:
        commits = commits.where(F.col("at") >= F.lit(since))
    if paths:
        commits = commits.where(F.arrays_overlap("files", F.array(*[F.lit(p) for p in paths])))
    return commits.orderBy(F.desc("at"), F.desc("commit")).limit(limit)


def hot_files(commits: DataFrame, last: int = 10, top: int = 5) -> DataFrame:
    """The files that most of the last commits touch."""
    named = recent_commits(commits, last).select(F.explode("files").alias("rel_path"))
    return named.groupBy("rel_path").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "rel_path").limit(top)


def dependency_cone(ix: Index, name: str) -> DataFrame:
    """Files that define a symbol of this name or call it, directly or at second hand."""
    own = ix.located_symbols().where(F.col("name") == name).select("rel_path")
    return own.union(direct_callers(ix, name).select("rel_path")).union(transitive_callers(ix, name).select("rel_path")).distinct()


def feature_history(commits: DataFrame, ix: Index, name: str, limit: int = 20) -> DataFrame:
    """The latest commits that touch a file of the symbol's cone."""
    touching = commits.select("commit", F.explode("files").alias("rel_path")).join(dependency_cone(ix, name), "rel_path", "left_semi").select("commit").distinct()
    return recent_commits(commits.join(touching, "commit", "left_semi"), limit)
