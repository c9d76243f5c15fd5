"""A project: its store, its source tree, and the operations that a user calls."""

from __future__ import annotations

import time
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import SCHEMAS
from ..sources import config as project_config
from ..sources import files as source_files
from ..sources import git
from . import history, impact, layers, lookup, postings, rules, search, summary
from .catalog import MOST_FOLDERS, Store, numbered, of_files, shifted
from .index import Index

TABLES = ("files", "symbols", "calls", "refs", "imports")
#: Folders that no pointer names any more stay so long, for readers that began before.
KEEP_HOURS = 24


class Project:
    def __init__(self, spark: SparkSession, root: str, store: str):
        self.spark, self.root, self.store = spark, root, Store(spark, store)
        self.config = project_config.load(root)

    @property
    def index(self) -> Index:
        return self.store.index()

    def scan(self) -> DataFrame:
        return source_files.scan(self.spark, self.root, project_config.ignore_patterns(self.root, self.config))

    def _write(self, ix: Index) -> None:
        """Every relation anew, and with them the text index."""
        self.store.commit({name: getattr(ix, name) for name in TABLES} | postings.relations_of(search.text_rows(ix)), cleared=("gone_files",))

    def _merge(self, new: Index, stale: DataFrame) -> None:
        """Add the rows of new files and let those of stale paths go: what is written grows with these alone."""
        old, new = self.index, shifted(new, self.store.top())
        gone = old.files.join(stale, "rel_path", "left_semi").select("file_id")
        added = {name: getattr(new, name) for name in TABLES} | postings.relations_of(search.text_rows(new))
        for name, less in postings.relations_of(search.text_rows(of_files(old, gone)), sign=-1).items():
            added[name] = lambda written, more=added[name], less=less: more(written).unionByName(less)
        self.store.commit({}, added | {"gone_files": gone})

    def compact(self, most_folders: int = MOST_FOLDERS, gone_share: float = 0.2) -> bool:
        """Write the relations anew if they lie in many folders, or many of their files are gone; whether it did."""
        if not (gone := self.store.read("gone_files").count()) and len(self.store.folders("files")) <= most_folders:
            return False
        ix = self.index
        if len(self.store.folders("files")) <= most_folders and gone <= gone_share * (gone + ix.files.count()):
            return False
        self._write(ix)
        return True

    @contextmanager
    def _built(self, sources: DataFrame):
        """An index of sources; they and their parsed rows are kept only while it is in use, or later scans would see
        these files again."""
        parsed, held = {k: v.persist() for k, v in source_files.parse(sources).items()}, []
        try:
            yield source_files.build(sources, parsed, held)
        finally:
            for df in [*held, *parsed.values()]:
                df.unpersist()

    def _after(self, facts: dict, now: datetime) -> None:
        known = history.set_knowledge(self.store.read("knowledge"), "last_rebuild", facts, now)
        for key, value in project_config.instruction_facts(self.root).items():
            known = history.set_knowledge(known, key, value, now)
        self.store.commit({"knowledge": known})
        if commit := git.head(self.root):
            self.snapshot(git_commit=commit, now=now)

    def rebuild(self, now: datetime | None = None) -> dict:
        """Index every file anew.  Annotations stay: they are kept by path and name."""
        began, now = time.time(), now or datetime.now()
        sources = self.scan().persist()
        with self._built(sources) as ix:
            self._write(ix)
        sources.unpersist()
        self.run_rules()
        self.store.vacuum(KEEP_HOURS)
        facts = summary.stats(self.index).first().asDict() | {"elapsed_seconds": round(time.time() - began, 2)}
        self._after(facts, now)
        return facts | {"parse_error_sample": [r.asDict() for r in self.index.files.where("parse_error is not null").orderBy("rel_path").select("rel_path", "parse_error").limit(5).collect()]}

    def changes(self) -> DataFrame:
        return history.detect_changes(self.store.read("files"), self.scan())

    def update(self, only: str | None = None, now: datetime | None = None) -> dict:
        """Index what changed since the last time: removed files go, new ones come, others are replaced.  Rules run again
        only if something changed."""
        sources = self.scan().persist()
        found = history.detect_changes(self.store.read("files"), sources)
        if only:
            found = found.where(F.col("rel_path") == only)
        found = found.persist()
        counts = history.change_counts(found).first().asDict()
        if any(counts.values()):
            stale = found.where("change_type <> 'added'").select("rel_path")
            fresh = sources.join(found.where("change_type <> 'deleted'").select("rel_path"), "rel_path", "left_semi")
            with self._built(fresh) as ix:
                self._merge(ix, stale)
            self.compact()
            self.run_rules()
            self.store.vacuum(KEEP_HOURS)
            self._after(counts, now or datetime.now())
        found.unpersist()
        sources.unpersist()
        return counts

    # -- rules ---------------------------------------------------------------------------------------------------

    def rules(self) -> list[rules.Rule]:
        own = [r.asDict() for r in self.store.read("rules").orderBy("rule_id").collect()]
        stored = {r["rule_id"]: rules.Rule(**{k: r[k] for k in ("rule_id", "name", "sql", "severity", "description", "is_builtin", "enabled", "weight", "learned_from")}) for r in own}
        return [*(stored.pop(b.rule_id, b) for b in rules.BUILTIN), *stored.values()]

    def add_rule(self, rule: rules.Rule, now: datetime | None = None) -> None:
        row = self.spark.createDataFrame([(rule.rule_id, rule.name, rule.description, rule.severity, rule.sql, rule.is_builtin, rule.enabled, now or datetime.now(), rule.weight, rule.learned_from)], SCHEMAS["rules"])
        self.store.commit({"rules": history.upsert(self.store.read("rules"), row, ["rule_id"], keep=["is_builtin", "created_at"])})

    def run_rules(self, rule_id: str | None = None, now: datetime | None = None) -> dict[str, int]:
        """Findings by rule; a rule's earlier findings are replaced."""
        now, chosen = now or datetime.now(), [r for r in self.rules() if rule_id in (None, r.rule_id)]
        found, runs = rules.run_rules(self.index, chosen, now)
        found = found.persist()
        counted = {r["rule_id"]: r["findings_count"] for r in runs.collect()}
        old = self.store.read("diagnostics")
        kept = rules.replace_findings(old, found, [r.rule_id for r in chosen]) if rule_id else found
        ranges: list[DataFrame] = []
        self.store.commit({"diagnostics": numbered(kept.drop("diag_id"), "diag_id", "rule_id", "context", "line_no", "message", held=ranges)})
        for df in ranges:
            df.unpersist()
        rows = self.spark.createDataFrame([(k, n, 0, now) for k, n in sorted(counted.items())], "rule_id string, findings_count int, useful_count int, ran_at timestamp_ntz")
        self.store.append("rule_runs", rows, "run_id")
        found.unpersist()
        return counted

    def findings(self, **criteria) -> DataFrame:
        return rules.list_findings(self.store.read("diagnostics"), self.store.read("files"), **criteria)

    def rate(self, rule_id: str, useful: bool) -> None:
        rating = self.spark.createDataFrame([(rule_id, int(useful))], "rule_id string, useful int")
        self.store.commit({"rule_runs": rules.rate(self.store.read("rule_runs"), rating)})

    def effectiveness(self) -> DataFrame:
        listed = self.spark.createDataFrame([(r.rule_id, r.name) for r in self.rules()], "rule_id string, name string")
        return rules.effectiveness(listed, self.store.read("rule_runs"))

    def conventions(self) -> DataFrame:
        return layers.violations(self.index, self.config.layers)

    # -- notes, sessions, snapshots ---------------------------------------------------------------------------------

    def annotate(self, note: str, symbol: str | None = None, rel_path: str | None = None, author: str = "user", now: datetime | None = None) -> None:
        about = lookup.resolve(self.index, symbol) if symbol else None
        if symbol and about is None:
            raise KeyError(symbol)
        row = (about["rel_path"], about["qualified_name"]) if about else (rel_path, None)
        df = self.spark.createDataFrame([(*row, note, author, now or datetime.now())], "rel_path string, qualified_name string, text string, author string, created_at timestamp_ntz")
        self.store.append("annotations", df, "annotation_id")

    def annotations(self) -> DataFrame:
        return history.attach_annotations(self.store.read("annotations"), self.index)

    def start_session(self, transcript_path: str | None = None, now: datetime | None = None) -> int:
        now, sessions = now or datetime.now(), self.store.read("sessions")
        open_one = F.col("ended_at").isNull()
        ended = sessions.withColumn("summary", F.when(open_one, F.lit(history.AUTO_END)).otherwise(F.col("summary"))).withColumn("ended_at", F.coalesce("ended_at", F.lit(now).cast("timestamp_ntz")))
        sid = (sessions.agg(F.max("session_id").alias("m")).first()["m"] or 0) + 1
        self.store.commit({"sessions": ended.unionByName(self.spark.createDataFrame([(sid, now, None, transcript_path, None)], SCHEMAS["sessions"]))})
        return sid

    def end_session(self, summary_text: str | None = None, now: datetime | None = None) -> None:
        sessions, now = self.store.read("sessions"), now or datetime.now()
        if not (row := history.active_session(sessions).first()):
            return
        mine = F.col("session_id") == row["session_id"]
        self.store.commit({"sessions": sessions.withColumn("ended_at", F.when(mine, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("ended_at"))).withColumn("summary", F.when(mine, F.lit(summary_text)).otherwise(F.col("summary")))})

    def record_changes(self, session_id: int, now: datetime | None = None) -> int:
        rows = history.record_changes(self.changes(), session_id, now or datetime.now()).persist()
        n = rows.count()
        self.store.append("change_log", rows, "change_id")
        rows.unpersist()
        return n

    def session_history(self, limit: int = 10) -> DataFrame:
        return history.session_history(self.store.read("sessions"), self.store.read("change_log"), limit)

    def snapshot(self, name: str | None = None, git_commit: str | None = None, now: datetime | None = None, keep: int = 20) -> str:
        now, ix = now or datetime.now(), self.index
        name = name or history.snapshot_name(now)
        states = {"snapshot_symbols": history.symbol_state(ix), "snapshot_calls": history.call_state(ix)}
        size = sum(df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))) + 1), F.lit(1)) + 1).first()[0] for df in states.values()) / 1024  # as JSON
        old = self.store.read("snapshots")
        sid = (old.agg(F.max("snapshot_id").alias("m")).first()["m"] or 0) + 1
        row = self.spark.createDataFrame([(sid, name, git_commit, now, round(size, 1))], SCHEMAS["snapshots"])
        kept = history.keep_newest(old.unionByName(row), keep)
        stay = {r["snapshot_id"] for r in kept.select("snapshot_id").collect()}  # at most ``keep``
        # A bucket that the newest snapshot has too stays where it is; its rows are written once.
        states = {k: history.bucketed(k, df) for k, df in states.items()}
        listed = self.store.read("snapshot_buckets")
        last = old.agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("m")).first()["m"]
        before = listed.where(F.col("snapshot_id") == F.lit(last)).select("what", "bucket", "digest", "home")
        own = history.state_digests(states).join(before, ["what", "bucket", "digest"], "left").select(F.lit(sid).cast("long").alias("snapshot_id"), "what", "bucket", "digest", F.coalesce("home", F.lit(sid).cast("long")).alias("home"))
        rows = [tuple(r) for r in own.collect()]  # a row a bucket
        fresh = {k: [r[2] for r in rows if r[1] == k and r[4] == sid] for k in states}
        buckets = listed.where(F.col("snapshot_id").isin(*stay)).unionByName(self.spark.createDataFrame(rows, SCHEMAS["snapshot_buckets"]))
        homes = {r["home"] for r in buckets.select("home").distinct().collect()}
        label = lambda folder: folder.rsplit("/", 1)[1].split("-")[0]
        gone = tuple({x for k in states for x in map(label, self.store.folders(k)) if int(x) not in stay | homes})
        added = {k: df.where(F.col("bucket").isin(fresh[k])).withColumn("snapshot_id", F.lit(sid)).sortWithinPartitions("bucket") for k, df in states.items()}
        self.store.commit({"snapshots": kept, "snapshot_buckets": buckets}, added, label=str(sid), dropped=gone)
        return name

    def _against(self, snapshot_id: int, ix: Index) -> dict[str, DataFrame]:
        """Changes since a snapshot: only buckets whose digests differ are read, on either side."""
        now = {"snapshot_symbols": history.bucketed("snapshot_symbols", history.symbol_state(ix)), "snapshot_calls": history.bucketed("snapshot_calls", history.call_state(ix))}
        then = self.store.read("snapshot_buckets").where(F.col("snapshot_id") == snapshot_id)
        there = {(r["what"], r["bucket"]): (r["digest"], r["home"]) for r in then.collect()}
        here = {(r["what"], r["bucket"]): r["digest"] for r in history.state_digests(now).collect()}
        differ = [key for key in {*there, *here} if here.get(key) != there.get(key, (None,))[0]]
        sides = []
        for what in now:
            places = [(b, there[what, b][1]) for w, b in differ if w == what and (what, b) in there]
            mine = text.any_of([(F.col("bucket") == b) & (F.col("snapshot_id") == home) for b, home in places])
            sides.append(self.store.read(what).where(mine).drop("snapshot_id", "bucket"))
        sides += [now[what].where(F.col("bucket").isin([b for w, b in differ if w == what])).drop("bucket") for what in now]
        return history.diff(*sides, names=now["snapshot_symbols"])

    def snapshots(self, limit: int = 20) -> DataFrame:
        return self.store.read("snapshots").orderBy(F.desc("created_at")).limit(limit).select("snapshot_id", "name", "git_commit", "created_at", "size_kb")

    def diff(self, snapshot: str | int | None = None, commit: str | None = None) -> dict[str, DataFrame]:
        """Structural changes since a snapshot (by name or id), or since a commit: by its snapshot, or else by parsing
        the files that changed since as they were then."""
        taken, ix = self.store.read("snapshots"), self.index
        if commit:
            full = (git.run(self.root, "rev-parse", commit) or commit).strip()
            chosen = taken.where(F.col("git_commit") == full)
        else:
            chosen = taken.where((F.col("name") == str(snapshot)) | (F.col("snapshot_id").cast("string") == str(snapshot)))
        # Of several snapshots of a commit the first is nearest to it: later ones hold edits on top.
        if found := chosen.orderBy("created_at" if commit else F.desc("created_at")).first():
            return self._against(found["snapshot_id"], ix)
        elif commit:
            paths = git.changed_files(self.root, commit)
            texts = [(p, t, "") for p in paths if "." in p and "." + p.rsplit(".", 1)[1].lower() in source_files.PARSERS and (t := git.file_at(self.root, commit, p)) is not None]
            then = source_files.build(self.spark.createDataFrame(texts, "rel_path string, content string, file_hash string"))
            old = tuple(history.state_with_files(f(ix), f(then), paths) for f in (history.symbol_state, history.call_state))
        else:
            raise KeyError(snapshot)
        return history.diff(*old, history.symbol_state(ix), history.call_state(ix))

    def commits(self, **options) -> DataFrame:
        return git.commits(self.spark, self.root, **options)

    # -- dispatch ------------------------------------------------------------------------------------------------------

    def call(self, tool: str, **args):
        """One entry for all tools: a dict, a DataFrame or a value, by the tool's name."""
        ix = self.index
        if tool not in ("index", "session") and ix.files.isEmpty():
            return {"warning": "the index is empty; run index first"}
        tools = {
            "index": lambda mode="incremental": self.update() if mode == "incremental" else self.rebuild(),
            "get_context": lambda name, kind=None: lookup.context(ix, name, kind, self.scan() if self.config.inline_source_max_lines else None, self.config.inline_source_max_lines),
            "callers": lambda name, limit=50: lookup.callers(ix, name, limit),
            "get_impact": lambda name: impact.impact(ix, name),
            "search": lambda query, kind=None, limit=20: search.search(ix, query, kind, limit),
            "file_summary": lambda path: summary.file_summary(ix, path),
            "diagnostics": self._diagnostics,
            "annotate": lambda text=None, **about: self.annotate(text, **about) if text else self.annotations(),
            "session": self._session,
            "check_conventions": self.conventions,
            "overview": lambda level=1: summary.overview(ix, level) | {"hot_files": history.hot_files(self.commits(limit=10))},
            "history": self._history,
        }
        if tool not in tools:
            raise KeyError(f"no tool {tool}")
        return tools[tool](**args)

    def _diagnostics(self, action: str = "list", **args):
        actions = {
            "run": lambda **a: self.run_rules(**a), "list": lambda **a: self.findings(**a), "add_rule": lambda **a: self.add_rule(rules.Rule(**a)), "test_rule": lambda sql: rules.try_rule(self.index, sql),
            "rate": lambda **a: self.rate(**a), "effectiveness": self.effectiveness,
        }
        return actions[action](**args)

    def _session(self, action: str = "status", **args):
        actions = {
            "start": lambda **a: self.start_session(**a), "end": lambda **a: self.end_session(**a), "status": lambda: history.active_session(self.store.read("sessions")),
            "changes": lambda **a: self.record_changes(**a), "history": lambda **a: self.session_history(**a),
        }
        return actions[action](**args)

    def _history(self, action: str = "recent_changes", **args):
        actions = {
            "diff": lambda **a: self.diff(**a), "feature_history": lambda name: history.feature_history(self.commits(limit=200), self.index, name),
            "recent_changes": lambda limit=20: self.commits(limit=limit), "snapshots": lambda **a: self.snapshots(**a),
        }
        return actions[action](**args)
