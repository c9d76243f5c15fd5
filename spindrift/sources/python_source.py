"""Python source text to rows, by the standard ast module.

Rows carry their tag (symbol, call, ref, import, error), their ordinal in the file, and as parent the ordinal of the
symbol they belong to.  A function within a class body, at any depth of functions, is a method of that class.
"""

from __future__ import annotations

import ast
import json

ROW = (
    "rel_path string, tag string, ordinal int, parent int, kind string, name string, params_json string, return_type string, "
    "decorators_json string, bases_json string, docstring string, line_start int, line_end int, complexity int, is_async int"
)
COLUMNS = [f.split()[0] for f in ROW.split(", ")]
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler)
DOCSTRING_LIMIT = 500


def complexity_of(node: ast.AST) -> int:
    """One, plus one for each if, loop, handler and and/or below the node."""
    return 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, _BRANCHES) for n in ast.walk(node))


def _parameters(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[dict]:
    a = node.args
    positional = [*a.posonlyargs, *a.args]
    defaults = dict(zip([x.arg for x in positional[len(positional) - len(a.defaults) :]], a.defaults, strict=True))
    defaults |= {x.arg: d for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None}
    rows = [("", x) for x in positional] + ([("*", a.vararg)] if a.vararg else []) + [("", x) for x in a.kwonlyargs] + ([("**", a.kwarg)] if a.kwarg else [])
    out = []
    for stars, x in rows:
        if x.arg in ("self", "cls"):
            continue
        entry = {"name": stars + x.arg}
        if x.annotation:
            entry["type"] = ast.unparse(x.annotation)
        if x.arg in defaults:
            entry["default"] = ast.unparse(defaults[x.arg])
        out.append(entry)
    return out


def _dotted(node: ast.AST) -> str | None:
    """a.b.c of names and attributes; calls and subscripts on the way stand as their text."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else None
    if isinstance(node, (ast.Call, ast.Subscript)):
        return ast.unparse(node)
    return None


class _Walk(ast.NodeVisitor):
    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.cls: int | None = None  # innermost class
        self.inside: int | None = None  # innermost function

    def add(self, tag: str, **fields) -> int:
        self.rows.append({"tag": tag, "ordinal": len(self.rows), **fields})
        return len(self.rows) - 1

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self.add("import", return_type=x.name, params_json=x.asname, is_async=0, line_start=node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for x in node.names:
            self.add("import", return_type="." * node.level + (node.module or ""), docstring=x.name, params_json=x.asname, is_async=1, line_start=node.lineno)

    def _symbol(self, node, kind: str, parent: int | None, **fields) -> int:
        doc = ast.get_docstring(node)
        return self.add(
            "symbol", kind=kind, name=node.name, parent=parent, decorators_json=json.dumps([ast.unparse(d) for d in node.decorator_list]),
            docstring=doc[:DOCSTRING_LIMIT] if doc else None, line_start=node.lineno, line_end=node.end_lineno, **fields,
        )

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = json.dumps([ast.unparse(b) for b in node.bases])
        own = self._symbol(node, "class", self.cls, bases_json=bases, params_json="[]", complexity=complexity_of(node), is_async=0)
        for x in (*node.decorator_list, *node.bases):
            self.visit(x)
        before, self.cls = self.cls, own
        for x in node.body:
            self.visit(x)
        self.cls = before

    def visit_FunctionDef(self, node) -> None:
        own = self._symbol(
            node, "method" if self.cls is not None else "function", self.cls, params_json=json.dumps(_parameters(node)), bases_json="[]",
            return_type=ast.unparse(node.returns) if node.returns else None, complexity=complexity_of(node), is_async=int(isinstance(node, ast.AsyncFunctionDef)),
        )
        for x in node.decorator_list:
            self.visit(x)
        before, self.inside = self.inside, own
        for x in (*node.args.defaults, *(d for d in node.args.kw_defaults if d), *node.body):
            self.visit(x)
        self.inside = before

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        if name := _dotted(node.func):
            self.add("call", name=name, parent=self.inside, line_start=node.lineno)
            if name.endswith(".connect") and node.args and isinstance(node.args[0], ast.Attribute):
                if (target := _dotted(node.args[0])) and target.startswith("self."):  # a handler: it is called later
                    self.add("call", name=target, parent=self.inside, line_start=node.lineno)
        self.generic_visit(node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if isinstance(node.value, ast.Name) and node.value.id == "self":
            self.add("ref", kind="read", return_type=f"self.{node.attr}", name=node.attr, parent=self.inside, line_start=node.lineno)
        self.generic_visit(node)


def parse(source: str, path: str) -> list[dict]:
    """Tagged rows of one file; a file that is no Python gives one error row."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"tag": "error", "ordinal": 0, "docstring": f"{type(e).__name__}: {e}"}]
    walk = _Walk()
    walk.visit(tree)
    return walk.rows
