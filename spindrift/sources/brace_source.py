"""Lightweight parsers for languages with braces: TypeScript, PowerShell, C, C++, C#, Go, Rust and Java.

One scanner serves them all.  It blanks strings and comments (keeping every position), pairs the braces, finds
declarations, imports and calls by each language's patterns, and gives each to the innermost declaration around it.  It
reads declarations as they are usually written; it is no grammar, and code made by macros or templates can escape it.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .python_source import DOCSTRING_LIMIT

ID = r"[A-Za-z_$][\w$]*"
COMMON_WORDS = frozenset("if for while switch catch return sizeof do else new delete throw await yield typeof case when using lock fixed match loop in is as and or not function func fn def class struct enum interface trait impl var let const elseif foreach until trap param begin process end defined static_assert alignof decltype super import".split())


@dataclass(frozen=True)
class Language:
    name: str
    suffixes: tuple[str, ...]
    #: (kind, pattern) with groups name and, where there are some, owner, params, returns, bases, async.  kind "class" or
    #: "interface" holds members; "function" becomes a method inside one or with an owner.
    declarations: tuple[tuple[str, str], ...]
    #: patterns with groups module and, where there are some, names, alias; from_ marks imports of names from a module.
    imports: tuple[tuple[str, bool], ...]
    branches: str
    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'`"
    refs: str = rf"\b({ID})((?:\.|->)({ID}))(?!\s*[\w$(<:])"
    constructor: str = r"\bnew\s+(" + ID + r"(?:(?:\.|::)" + ID + r")*)"
    new_prefix: str = ""
    calls: str = rf"(?<![\w$.:>@-])((?:{ID}(?:\s*(?:\.|::|->|\?\.)\s*)?)*{ID})\s*(?:::)?(?:<[^<>()=;]*>)?\s*\("
    macro: str = ""
    bodies: bool = True
    extra: tuple = field(default=())


PARAMS = r"\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)"
MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|override|virtual|sealed|async|partial|readonly|unsafe|extern|default|new|strictfp|required)\s+)*"
GENERIC = r"(?:<[^<>{};]*(?:<[^<>{};]*>[^<>{};]*)*>)?"
TYPE = rf"(?P<returns>[A-Za-z_][\w.:]*{GENERIC}(?:\s*\[[\s,]*\])*\??(?:\s*[*&]+)?)"
C_TYPE = r"(?P<returns>(?:(?:static|inline|extern|const|unsigned|signed|struct|enum|long|short|virtual|constexpr|explicit|friend|typename)\s+)*[A-Za-z_][\w:]*" + GENERIC + r"(?:\s+const)?[\s*&]+)"

LANGUAGES = (
    Language(
        "typescript", (".ts", ".tsx"),
        (
            ("class", rf"\b(?:abstract\s+)?class\s+(?P<name>{ID}){GENERIC}(?P<bases>[^{{]*)(?=\{{)"),
            ("interface", rf"\binterface\s+(?P<name>{ID}){GENERIC}(?P<bases>[^{{]*)(?=\{{)"),
            ("interface", rf"\btype\s+(?P<name>{ID}){GENERIC}\s*="),
            ("class", rf"\benum\s+(?P<name>{ID})\s*(?=\{{)"),
            ("function", rf"\b(?P<async>async\s+)?function\s*\*?\s*(?P<name>{ID}){GENERIC}\s*{PARAMS}(?:\s*:\s*(?P<returns>[^{{;=]+))?\s*(?=\{{)"),
            ("function", rf"\b(?:const|let|var)\s+(?P<name>{ID})(?:\s*:[^=;]+)?\s*=\s*(?P<async>async\s*)?(?:{PARAMS}|{ID})(?:\s*:\s*(?P<returns>[^={{;]+))?\s*=>\s*"),
            ("method", rf"(?:^|[;{{}}])\s*(?:(?:public|private|protected|static|readonly|override|abstract|get|set)\s+)*(?P<async>async\s+)?\*?(?P<name>#?{ID}){GENERIC}\s*{PARAMS}(?:\s*:\s*(?P<returns>[^{{;=]+))?\s*(?=\{{)"),
        ),
        ((rf"\bimport\s+(?:type\s+)?(?P<names>[^'\";]+?)\s+from\s*(?P<module>['\"][^'\"]+['\"])", True), (r"\bimport\s*(?P<module>['\"][^'\"]+['\"])", False)),
        r"\b(?:if|for|while|catch|case)\b|\?(?![.?:])|&&|\|\||\?\?", refs=rf"\b(this)(\.({ID}))(?!\s*[\w$(])",
    ),
    Language(
        "powershell", (".ps1", ".psm1", ".psd1"),
        (
            ("class", rf"(?i)\b(?:class|enum)\s+(?P<name>{ID})(?:\s*:\s*(?P<bases>[^{{]*))?\s*(?=\{{)"),
            ("function", rf"(?i)\b(?:function|filter)\s+(?P<name>[\w:-]+)\s*(?:{PARAMS})?\s*(?=\{{)"),
            ("method", rf"(?:^|[;{{}}])\s*(?:(?:static|hidden)\s+)*(?:\[(?P<returns>[\w.\[\]]+)\]\s*)?(?P<name>{ID})\s*{PARAMS}\s*(?=\{{)"),
        ),
        ((r"(?im)^\s*Import-Module\s+(?:-Name\s+)?(?P<module>[^\s;|]+)", False), (r"(?im)^\s*\.\s+(?P<module>[^\s;|]+)", False), (r"(?im)^\s*using\s+(?:module|namespace|assembly)\s+(?P<module>[^\s;]+)", False)),
        r"(?i)\b(?:if|elseif|for|foreach|while|catch|switch)\b|-(?:and|or)\b", ("#",), (("<#", "#>"),), "\"'", r"(\$this)(\.(" + ID + r"))(?!\s*[\w(])", r"(?!x)x",
        calls=rf"(?<![\w$-])((?:\$?{ID}\.)+{ID})\s*\(|(?m:(?:^|[;{{|(=&])\s*)([A-Za-z]+-[A-Za-z][\w]*)",
    ),
    Language(
        "c", (".c", ".h"),
        (
            ("class", rf"\b(?:struct|enum|union)\s+(?P<name>{ID})\s*(?=\{{)"),
            ("class", rf"\btypedef\s+(?:struct|enum|union)\s*(?:{ID})?\s*\{{[^{{}}]*\}}\s*(?P<name>{ID})\s*;"),
            ("function", rf"(?:^|[;}}])\s*{C_TYPE}(?P<name>{ID})\s*{PARAMS}\s*(?=\{{)"),
        ),
        ((r"(?m)^[ \t]*#\s*include\s*(?P<module><[^>\n]+>)", True), (r"(?m)^[ \t]*#\s*include\s*(?P<module>\"[^\"\n]+\")", False)),
        r"\b(?:if|for|while|case)\b|\?|&&|\|\|", quotes="\"'",
    ),
    Language(
        "cpp", (".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".hh"),
        (
            ("class", rf"\b(?:class|struct)\s+(?P<name>{ID})(?:\s+final)?\s*(?P<bases>:[^{{;]*)?(?=\{{)"),
            ("class", rf"\benum\s+(?:class\s+)?(?P<name>{ID})[^{{;]*(?=\{{)"),
            ("function", rf"(?:^|[;{{}}:>])\s*(?:{C_TYPE})?(?:(?P<owner>{ID}){GENERIC}::)?(?P<name>~?{ID}|operator\s*[^\s(]+)\s*{PARAMS}\s*(?:const|noexcept|override|final|\s)*(?:->\s*[\w:<>*& ]+)?(?::[^{{;]*)?(?=\{{)"),
        ),
        ((r"(?m)^[ \t]*#\s*include\s*(?P<module><[^>\n]+>)", True), (r"(?m)^[ \t]*#\s*include\s*(?P<module>\"[^\"\n]+\")", False)),
        r"\b(?:if|for|while|case|catch)\b|\?|&&|\|\|", quotes="\"'",
    ),
    Language(
        "csharp", (".cs",),
        (
            ("interface", rf"\binterface\s+(?P<name>{ID}){GENERIC}\s*(?P<bases>:[^{{]*)?(?=\{{)"),
            ("class", rf"\b(?:class|struct|record|enum)\s+(?P<name>{ID}){GENERIC}\s*(?:\([^()]*\))?\s*(?P<bases>:[^{{]*)?(?=\{{)"),
            ("method", rf"(?:^|[;{{}}\]])\s*{MODIFIERS}(?:{TYPE}\s+)?(?P<name>{ID}){GENERIC}\s*{PARAMS}\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*)?(?:where[^{{]*)?(?=\{{|=>)"),
            ("method", rf"(?:^|[;{{}}\]])\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|required)\s+)+{TYPE}\s+(?P<name>{ID})\s*(?=\{{\s*(?:get|set|private|protected|internal|init)\b)"),
        ),
        ((r"\busing\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<module>[\w.]+)\s*;", False),),
        r"\b(?:if|for|foreach|while|case|catch)\b|\?(?![.?\[>;,)])|&&|\|\||\?\?", quotes="\"'",
    ),
    Language(
        "go", (".go",),
        (
            ("class", rf"\btype\s+(?P<name>{ID})(?:\[[^\]]*\])?\s+struct\s*(?=\{{)"),
            ("interface", rf"\btype\s+(?P<name>{ID})(?:\[[^\]]*\])?\s+interface\s*(?=\{{)"),
            ("function", rf"\bfunc\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>{ID})(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>{ID})(?:\[[^\]]*\])?\s*{PARAMS}\s*(?P<returns>\([^()]*\)|[^{{\n]*?)\s*(?=\{{)"),
        ),
        ((r"\bimport\s+(?:(?P<alias>[\w.]+)\s+)?(?P<module>\"[^\"\n]+\")", False), (r"(?m)^\s*(?:(?P<alias>[\w.]+)[ \t]+)?(?P<module>\"[^\"\n]+\")[ \t]*$", False)),
        r"\b(?:if|for|case|switch|select)\b|&&|\|\|", quotes="\"'`", constructor=rf"(?<![\w.])&?([A-Z]\w*(?:\.\w+)?)(?=\{{)",
    ),
    Language(
        "rust", (".rs",),
        (
            ("class", rf"\b(?:struct|enum|union)\s+(?P<name>{ID}){GENERIC}"),
            ("interface", rf"\btrait\s+(?P<name>{ID}){GENERIC}\s*(?P<bases>:[^{{]*)?(?=\{{)"),
            ("impl", rf"\bimpl\b\s*{GENERIC}\s*(?:(?P<bases>[\w:]+){GENERIC}\s+for\s+)?(?P<name>{ID}){GENERIC}[^{{;]*(?=\{{)"),
            ("function", rf"\b(?P<async>async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(?P<name>{ID})\s*{GENERIC}\s*{PARAMS}(?:\s*->\s*(?P<returns>[^{{;]+?))?\s*(?:where[^{{;]*)?(?=\{{|;)"),
        ),
        ((r"\buse\s+(?P<module>[\w:]+?)(?:::\{(?P<names>[^}]*)\}|::\*)?(?:\s+as\s+(?P<alias>\w+))?\s*;", True), (r"\bextern\s+crate\s+(?P<module>\w+)", False)),
        r"\b(?:if|for|while|loop|match)\b|=>|&&|\|\|", quotes="\"", constructor=r"(?!x)x", macro=rf"\b({ID}!)\s*[(\[{{]",
    ),
    Language(
        "java", (".java",),
        (
            ("interface", rf"\b@?interface\s+(?P<name>{ID}{GENERIC})\s*(?P<bases>[^{{]*)(?=\{{)"),
            ("class", rf"\b(?:class|enum|record)\s+(?P<name>{ID}{GENERIC})\s*(?:\([^()]*\))?\s*(?P<bases>[^{{]*)(?=\{{)"),
            ("method", rf"(?:^|[;{{}})])\s*(?:@{ID}(?:\([^()]*\))?\s*)*{MODIFIERS}(?:<[^<>]*>\s*)?(?:{TYPE}\s+)?(?P<name>{ID})\s*{PARAMS}\s*(?:throws\s+[\w.,\s]+)?(?=\{{)"),
        ),
        ((r"\bimport\s+static\s+(?P<module>[\w.]+)\s*;", True), (r"\bimport\s+(?P<module>[\w.]+(?:\.\*)?)\s*;", False)),
        r"\b(?:if|for|while|case|catch)\b|\?(?![>\s]*[>,]|\s+(?:extends|super))|&&|\|\|", quotes="\"'", new_prefix="new ",
    ),
)


def _blanked(source: str, lang: Language) -> tuple[str, list[tuple[int, int, str]]]:
    """The source with strings and comments as spaces, and the comments as (start, end, text)."""
    starts = [re.escape(a) for a, _ in lang.block_comments] + [re.escape(a) for a in lang.line_comments]
    quotes = [q for q in lang.quotes if not (lang.name == "rust" and q == "'")]
    opener = re.compile("|".join([*starts, *map(re.escape, quotes)]))
    ends, out, comments, at = dict(lang.block_comments), [], [], 0
    while m := opener.search(source, at):
        out.append(source[at : m.start()])
        token = m.group()
        if token in ends:
            stop = source.find(ends[token], m.end())
            stop = len(source) if stop < 0 else stop + len(ends[token])
            comments.append((m.start(), stop, source[m.start() : stop]))
        elif token in lang.line_comments:
            stop = source.find("\n", m.end())
            stop = len(source) if stop < 0 else stop
            comments.append((m.start(), stop, source[m.start() : stop]))
        else:
            stop, many = m.end(), token == "`"
            while stop < len(source) and source[stop] != token and (many or source[stop] != "\n"):
                stop += 2 if source[stop] == ("`" if lang.name == "powershell" else "\\") and not (many and lang.name == "go") else 1
            stop = min(len(source), stop + 1)
        out.append(re.sub(r"[^\n]", " ", source[m.start() : stop]))
        at = stop
    out.append(source[at:])
    return "".join(out), comments


def _pairs(code: str) -> dict[int, int]:
    stack, pairs = [], {}
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs


def _documentation(comments: list[tuple[int, int, str]], code: str, start: int) -> str | None:
    """The comment that ends on the line before a declaration (attributes and annotations may stand between)."""
    found, at = [], start
    for first, last, body in reversed(comments):
        if last > at:
            continue
        between = code[last:at]
        if not re.fullmatch(r"(?:\s|@[\w.]+(?:\([^)]*\))?|#?\[[^\]]*\]|export|default|public|private|protected|static|abstract|pub(?:\([^)]*\))?|async|final|template\s*<[^>]*>)*", between) or between.count("\n") > 4:
            break
        found.append(body)
        at = first
        if not re.match(r"//|#(?!>)", body):
            break
    if not found:
        return None
    lines = []
    for body in reversed(found):
        for line in re.sub(r"^(/\*+!?|<#)|(\*+/|#>)$", "", body).splitlines():
            lines.append(re.sub(r"<[^>]+>", "", re.sub(r"^\s*(?:///?!?|\*|#+)\s?", "", line)).strip())
    return "\n".join(lines).strip()[:DOCSTRING_LIMIT] or None


def _parameters(params: str | None) -> str:
    out = []
    for part in re.split(r",(?![^<(\[{]*[>)\]}])", params or ""):
        part = part.strip()
        bare, _, default = part.partition("=")
        names = re.findall(r"\$?[A-Za-z_][\w$]*", bare.split(":")[0] if ":" in bare and "::" not in bare else bare)
        if names and names[-1] not in ("self", "this", "void"):
            out.append({"name": names[-1].lstrip("$")} | ({"default": default.strip()} if default.strip() else {}))
    return json.dumps(out)


def parse_with(lang: Language) -> Callable[[str, str], list[dict]]:
    declarations = [(kind, re.compile(p, re.M)) for kind, p in lang.declarations]
    imports = [(re.compile(p), named) for p, named in lang.imports]
    calls, refs, made, branch = re.compile(lang.calls), re.compile(lang.refs), re.compile(lang.constructor), re.compile(lang.branches)
    macro = re.compile(lang.macro) if lang.macro else None

    def parse(source: str, path: str) -> list[dict]:
        code, comments = _blanked(source, lang)
        pairs, newlines = _pairs(code), [m.start() for m in re.finditer("\n", source)]
        line = lambda at: bisect.bisect_left(newlines, at) + 1
        found: dict[int, dict] = {}
        for kind, pattern in declarations:
            for m in pattern.finditer(code):
                at, g = m.start("name"), m.groupdict()
                name = g["name"].strip()
                if at in found or name in COMMON_WORDS or (kind == "method" and g.get("returns") in ("return", "new", "else", "throw", "await")):
                    continue
                brace = m.end() if code[m.end() : m.end() + 1] == "{" else code.find("{", m.end(), code.find("\n", m.end()) if "\n" in code[m.end() :] else len(code)) if "=>" in m.group() or kind == "class" else -1
                end = pairs.get(brace, len(code) - 1 if brace >= 0 else m.end())
                if m.group().startswith("typedef"):
                    end = m.end()
                head = m.start() + len(m.group()) - len(m.group().lstrip(" \n\t;{}:)>]"))
                found[at] = {"kind": kind, "name": name, "start": head, "brace": brace, "end": end, "group": g, "at": at}
        items = sorted(found.values(), key=lambda x: (x["start"], -x["end"]))
        rows: list[dict] = []
        add = lambda tag, **fields: rows.append({"tag": tag, "ordinal": len(rows), **fields}) or len(rows) - 1
        raw = source if lang.name in ("c", "cpp", "go", "typescript", "powershell") else code
        taken: set[int] = set()
        for pattern, named in imports:
            for m in pattern.finditer(raw):
                if m.start("module") in taken or (lang.name == "go" and "import" not in m.group() and not re.search(r"import\s*\([^)]*$", source[: m.start("module")])) or any(a <= m.start() < b for a, b, _ in comments):
                    continue
                taken.add(m.start("module"))
                g = m.groupdict()
                names = re.findall(r"(\*|[\w$]+)(?:\s+as\s+([\w$]+))?", (g.get("names") or "").replace("{", "").replace("}", "")) or [(None, g.get("alias"))]
                for name, alias in names:
                    add("import", return_type=g["module"].strip("\"'<>"), docstring=name, params_json=alias or g.get("alias"), is_async=int(named), line_start=line(m.start("module")))
        owners: dict[str, int] = {}
        placed: list[dict] = []
        for x in items:
            around = [p for p in placed if p["brace"] >= 0 and p["brace"] < x["at"] < p["end"]]
            holder = next((p for p in reversed(around) if p["kind"] in ("class", "interface", "impl")), None)
            if x["kind"] == "method" and (holder is None or any(p["kind"] == "function" and p["start"] > holder["start"] for p in around)) and lang.name not in ("csharp", "java"):
                continue  # a call with a block, not a declaration
            if x["kind"] == "impl":
                if x["name"] not in owners:
                    owners[x["name"]] = add("symbol", kind="class", name=x["name"], params_json="[]", bases_json="[]", decorators_json='["impl"]', line_start=line(x["at"]), line_end=line(x["end"]), complexity=1, is_async=0)
                x["ordinal"] = owners[x["name"]]
                placed.append(x)
                continue
            g = x["group"]
            parent = owners.get(g["owner"]) if g.get("owner") else holder["ordinal"] if holder else None
            kind = x["kind"] if x["kind"] in ("class", "interface") else "method" if parent is not None else "function"
            bases = re.findall(rf"{ID}(?:[.:]+{ID})*", re.sub(r"\b(extends|implements|public|private|protected|virtual|where)\b|<[^<>]*>", " ", g.get("bases") or ""))
            x["ordinal"] = add(
                "symbol", kind=kind, name=x["name"], parent=parent, params_json=_parameters(g.get("params")), bases_json=json.dumps(bases), decorators_json="[]",
                return_type=(g.get("returns") or "").strip() or None, docstring=_documentation(comments, code, x["start"]), line_start=line(x["at"]), line_end=line(x["end"]),
                complexity=1 + len(branch.findall(code[x["brace"] : x["end"]])) if x["brace"] >= 0 else 1, is_async=int(bool(g.get("async"))),
            )
            if kind in ("class", "interface"):
                owners.setdefault(x["name"], x["ordinal"])
            x["kind"] = kind
            placed.append(x)
        functions = [p for p in placed if p["kind"] in ("function", "method") and p["brace"] >= 0]
        heads = {p["at"] for p in placed}

        def inside(at: int) -> int | None:
            own = [p for p in functions if p["brace"] < at < p["end"]]
            return own[-1]["ordinal"] if own else None

        for m in made.finditer(code):
            add("call", name=lang.new_prefix + m[1], parent=inside(m.start()), line_start=line(m.start()))
        built = {m.start(1) for m in made.finditer(code)}
        for m in calls.finditer(code):
            group = 1 if m[1] else 2
            name, at = re.sub(r"\s+|\?", "", m[group]), m.start(group)
            last = re.split(r"\.|::|->", name)[-1]
            if at in heads or at in built or m.end(group) - len(last) in heads or (last in COMMON_WORDS and last == name) or re.split(r"\.|::|->", name)[0] in COMMON_WORDS - {"super", "this"}:
                continue
            add("call", name=name, parent=inside(at), line_start=line(at))
        for m in macro.finditer(code) if macro else ():
            add("call", name=m[1], parent=inside(m.start()), line_start=line(m.start()))
        for m in refs.finditer(code):
            add("ref", kind="read", return_type=m[1] + m[2], name=m[3], parent=inside(m.start()), line_start=line(m.start()))
        return rows

    return parse


PARSERS = {suffix: (lang.name, parse_with(lang)) for lang in LANGUAGES for suffix in lang.suffixes}
