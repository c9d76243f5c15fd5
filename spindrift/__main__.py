"""Command line and JSON-RPC over stdio: python -m spindrift [--root R] [--store S] COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame, SparkSession

from .operators.project import Project

TOOLS = ("index", "get_context", "callers", "get_impact", "search", "file_summary", "diagnostics", "annotate", "session", "check_conventions", "overview", "history")
#: command: (tool, name of its argument or None, fixed arguments)
COMMANDS = {
    "init": ("index", None, {"mode": "full"}), "update": ("index", None, {"mode": "incremental"}), "callers": ("callers", "name", {}), "context": ("get_context", "name", {}),
    "impact": ("get_impact", "name", {}), "search": ("search", "query", {}), "file": ("file_summary", "path", {}), "diagnostics": ("diagnostics", None, {"action": "list"}),
    "stats": ("overview", None, {"level": 0}), "check-conventions": ("check_conventions", None, {}),
}


def plain(value):
    """A tool's answer as JSON values; tables become lists of rows (the tools bound them)."""
    if isinstance(value, DataFrame):
        return [json.loads(r) for r in value.toJSON().collect()]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def answer(project: Project, message: dict) -> dict | None:
    """The JSON-RPC reply to one message; None for a notification."""
    method, params, mid = message.get("method"), message.get("params") or {}, message.get("id")
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "spindrift", "version": "1"}}
        elif method == "notifications/initialized":
            return None
        elif method == "tools/list":
            result = {"tools": [{"name": t, "description": t.replace("_", " "), "inputSchema": {"type": "object"}} for t in TOOLS]}
        elif method == "tools/call":
            found = plain(project.call(params["name"], **(params.get("arguments") or {})))
            result = {"content": [{"type": "text", "text": json.dumps(found, default=str)}]}
        else:
            return {"jsonrpc": "2.0", "id": mid, "error": {"code": -32601, "message": f"unknown method {method}"}}
    except Exception as e:  # a failing tool must not end the server
        return {"jsonrpc": "2.0", "id": mid, "error": {"code": -32603, "message": f"{type(e).__name__}: {e}"}}
    return {"jsonrpc": "2.0", "id": mid, "result": result}


def serve(project: Project, lines: IO[str], out: IO[str]) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(project, json.loads(line))
        except ValueError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spindrift")
    parser.add_argument("--root", default=".")
    parser.add_argument("--store")
    parser.add_argument("command", choices=[*COMMANDS, "serve"])
    parser.add_argument("value", nargs="?")
    given = parser.parse_args(args)
    root = str(Path(given.root).resolve())
    project = Project(spark or SparkSession.builder.appName("spindrift").getOrCreate(), root, given.store or f"file://{root}/.spindrift")
    if given.command == "serve":
        serve(project, sys.stdin, sys.stdout)
        return 0
    tool, argument, fixed = COMMANDS[given.command]
    if argument and not given.value:
        parser.error(f"{given.command} needs a {argument}")
    print(json.dumps(plain(project.call(tool, **fixed, **({argument: given.value} if argument else {}))), indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
