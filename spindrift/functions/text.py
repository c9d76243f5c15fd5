"""Column expressions over names, paths and expressions; all inside Spark's own functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names taken for built-in functions when a call is categorised.
BUILTIN_NAMES = [
    "print", "len", "range", "int", "str", "float", "bool", "list", "dict",
    "tuple", "set", "type", "isinstance", "issubclass", "hasattr", "getattr",
    "setattr", "super", "enumerate", "zip", "map", "filter", "sorted", "reversed",
    "min", "max", "sum", "abs", "round", "any", "all", "next", "iter",
    "open", "repr", "id", "hash", "callable", "vars", "dir",
]


def last_segment(expr: Column) -> Column:
    return F.substring_index(expr, ".", -1)


def callee_name(expr: Column) -> Column:
    """The called name of an expression in any supported language: ``new X``, ``a::b``, ``p->f`` and ``name!`` included."""
    bare = F.regexp_replace(F.regexp_replace(expr, r"^new\s+", ""), r"!$", "")
    return F.regexp_extract(bare, r"([^.:>]*)$", 1)


def qualified(parent: Column, name: Column) -> Column:
    return F.when(parent.isNull() | (parent == ""), name).otherwise(F.concat_ws(".", parent, name))


def contains_like(col: Column, needle: str) -> Column:
    """Substring match as LIKE does it: case-insensitive, with % and _ in the needle as wildcards."""
    return col.ilike(f"%{needle}%")


def names_symbol(callee_expr: Column, name: str, compat: bool = False) -> Column:
    """Does a call expression name this symbol: the expression or its last segment is the name.

    compat adds what LIKE would: any letter case after a dot, and wildcards in the name.
    """
    exact = last_segment(callee_expr) == name if "." not in name else (callee_expr == name) | callee_expr.endswith("." + name)
    return exact | callee_expr.ilike("%." + name) if compat else exact


def top_module(path: Column) -> Column:
    """The first folder of a path, or (root)."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("(root)")


def module_key(path: Column) -> Column:
    """The dotted module of a path; only a final .py goes."""
    return F.regexp_replace(F.regexp_replace(path, r"[/\\]", "."), r"\.py$", "")


def module_key_compat(path: Column) -> Column:
    """The dotted module as REPLACE makes it: every .py goes, wherever it stands."""
    return F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit(".py"), F.lit(""))


def call_category(expr: Column) -> Column:
    """self_method, self_attr_method, builtin, external or local."""
    parts = F.split(expr, r"\.")
    return (
        F.when(F.get(parts, F.lit(0)) == "self", F.when(F.size(parts) >= 3, "self_attr_method").otherwise("self_method"))
        .when(last_segment(expr).isin(BUILTIN_NAMES), "builtin")
        .when(F.contains(expr, F.lit(".")) & ~expr.startswith("self"), "external")
        .otherwise("local")
    )


def name_score(name: Column, query: str) -> Column:
    """100 equal, 50 prefix, 90 equal but for case, 40 prefix but for case, else 10; in this order."""
    low = query.lower()
    return (
        F.when(name == query, 100).when(name.startswith(query), 50).when(F.lower(name) == low, 90).when(F.lower(name).startswith(low), 40).otherwise(10)
    )


def query_tokens(query: str) -> list[str]:
    """Lower-case tokens of a query, split at white space and underscores."""
    return [t.lower() for t in query.replace("_", " ").split()]


def _accented() -> dict[str, str]:
    """Letters up to U+1EFF that Unicode decomposes into one ASCII letter and one mark, with that letter, and the long s."""
    split = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x1F00)}
    return {c: d[0] for c, d in split.items() if len(d) == 2 and d[0].isascii() and d[0].isalpha()} | {"\u017f": "s", "\u1e9b": "s"}


ACCENTED = _accented()
MARKS = "".join(sorted({d[1] for d in (unicodedata.normalize("NFD", c) for c in ACCENTED) if len(d) == 2 and d[0].isascii()}))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without the accents of Latin letters, whether composed or combining."""
    return F.regexp_extract_all(F.lower(fold_accents(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


#: All marks lie in one range, which is asked first: a class of single characters is tried one by one.
_ANY_MARK = "\u0300-\u036f"


def token_count(text: Column) -> Column:
    """How many tokens word_tokens finds; neither case nor folded accents move their bounds, and marks stay inside."""
    return F.regexp_count(text, F.lit(rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}[{_ANY_MARK}&&[{MARKS}]]]*"))


def fold_accents(text: Column) -> Column:
    """Latin letters without accents; texts that have none are not walked through."""
    return F.when(text.rlike(f"[À-ɏ{_ANY_MARK}Ḁ-ỿ]"), _folded(text)).otherwise(text)


def _folded(text: Column) -> Column:
    return F.translate(text, "".join(ACCENTED) + MARKS, "".join(ACCENTED.values()))  # a mark has no letter: it goes


def fold_word(word: str) -> str:
    """What fold_accents makes of a word of a query."""
    return word.translate(str.maketrans(ACCENTED) | dict.fromkeys(map(ord, MARKS)))


def preview(text: Column, n: int) -> Column:
    """The first n characters, null if that is nothing."""
    return F.nullif(F.substring(text, 1, n), F.lit(""))


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def source_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included) of a text."""
    return F.array_join(F.slice(F.split(content, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
