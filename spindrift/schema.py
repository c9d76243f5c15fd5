"""Declared schemas of the index relations.

Flags are 0/1 integers, so that rule SQL can compare them with numbers; ids are longs; times are time-zone-free.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

DDL = {
    "files": "file_id long, rel_path string, file_hash string, language string, line_count int, parse_error string, indexed_at timestamp_ntz",
    "symbols": "symbol_id long, file_id long, parent_id long, kind string, name string, params_json string, return_type string, decorators_json string, "
    "bases_json string, docstring string, line_start int, line_end int, complexity int, is_async int",
    "calls": "call_id long, file_id long, caller_id long, callee_expr string, line_no int",
    "refs": "ref_id long, file_id long, symbol_id long, ref_kind string, target string, name string, line_no int",
    "imports": "import_id long, file_id long, module string, name string, alias string, is_from int, line_no int",
    "rules": "rule_id string, name string, description string, severity string, sql string, is_builtin int, enabled int, created_at timestamp_ntz, weight double, learned_from string",
    "rule_runs": "run_id long, rule_id string, findings_count int, useful_count int, ran_at timestamp_ntz",
    "diagnostics": "diag_id long, file_id long, rule_id string, severity string, message string, line_no int, context string, is_resolved int, first_seen timestamp_ntz, last_seen timestamp_ntz",
    "sessions": "session_id long, started_at timestamp_ntz, ended_at timestamp_ntz, transcript_path string, summary string",
    "change_log": "change_id long, session_id long, rel_path string, change_type string, old_hash string, new_hash string, changed_at timestamp_ntz",
    "annotations": "annotation_id long, rel_path string, qualified_name string, text string, author string, created_at timestamp_ntz",
    "knowledge": "key string, value_json string, updated_at timestamp_ntz",
    "snapshots": "snapshot_id long, name string, git_commit string, created_at timestamp_ntz, size_kb double",
    "snapshot_symbols": "snapshot_id long, n string, k string, f string, ls int, le int, p string, bucket int",
    "snapshot_calls": "snapshot_id long, cr string, ce string, f string, l int, bucket int",
    "snapshot_buckets": "snapshot_id long, what string, bucket int, digest string, home long",
    "text_postings": "kind string, term string, slot long, max_tf int, min_length int, rows array<struct<key:long,tf:int,length:int,file_id:long>>, bucket int",
    "text_terms": "kind string, term string, n long, bucket int",
    "text_sizes": "kind string, n long, tokens long",
    "gone_files": "file_id long",
    "meta": "key string, value string",
}

SCHEMA_VERSION = 2
_PLAIN = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType()}


def _type(ddl: str) -> T.DataType:
    if ddl.startswith("array<"):
        return T.ArrayType(_type(ddl[6:-1]))
    if ddl.startswith("struct<"):
        return T.StructType([T.StructField(*(f(x) for f, x in zip((str, _type), pair.split(":"), strict=True))) for pair in ddl[7:-1].split(",")])
    return _PLAIN[ddl]


def _schema(ddl: str) -> T.StructType:
    """The declared types, without the session that Spark's own parser needs."""
    fields = re.findall(r"(\w+) ((?:array<.*?>>)|\w+)(?:, |$)", ddl)
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in fields])


SCHEMAS: dict[str, T.StructType] = {name: _schema(ddl) for name, ddl in DDL.items()}
#: Relations that belong to a file and go when it goes.
FILE_RELATIONS = ("symbols", "calls", "refs", "imports", "diagnostics")
#: Relations whose rows lie in folders by a column.
FOLDERS_BY = {"text_postings": "bucket", "text_terms": "bucket"}

PARAMS_DDL = "array<struct<name:string,type:string,default:string,modifiers:array<string>>>"
STRINGS_DDL = "array<string>"
