"""Project configuration from .spindrift.yaml or .yml: a small subset of YAML, read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.layers import Layer

FILE_NAMES = (".spindrift.yaml", ".spindrift.yml")


@dataclass
class ProjectConfig:
    name: str = ""
    repo: str = ""
    instructions: str = ""
    ignore: list[str] = field(default_factory=list)
    layers: list[Layer] = field(default_factory=list)
    seed_rules_from: list[str] = field(default_factory=list)
    inline_source_max_lines: int = 0


def _scalar(value: str):
    value = value.strip()
    if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
        return value[1:-1]
    if value.startswith("[") and value.endswith("]"):
        return [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,]+", value[1:-1]) if x.strip()]
    value = re.sub(r"\s+#.*$", "", value)
    if re.fullmatch(r"-?\d+", value):
        return int(value)
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(value, value)


def parse_yaml(source: str):
    """Nested maps, lists of scalars, lists of maps, inline lists; comments and blank lines are skipped."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in source.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, depth: int):
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            out: list = []
            while i < len(lines) and lines[i][0] == depth and lines[i][1].startswith("-"):
                rest = lines[i][1][1:].strip()
                if re.match(r"[\w.-]+\s*:(\s|$)", rest):
                    inner = depth + 2
                    lines[i] = (inner, rest)
                    value, i = block(i, inner)
                    out.append(value)
                else:
                    out.append(_scalar(rest))
                    i += 1
            return out, i
        found: dict = {}
        while i < len(lines) and lines[i][0] == depth and not lines[i][1].startswith("- "):
            key, _, rest = lines[i][1].partition(":")
            i += 1
            if rest.strip() and not rest.strip().startswith("#"):
                found[key.strip()] = _scalar(rest)
            elif i < len(lines) and (lines[i][0] > depth or (lines[i][0] == depth and lines[i][1].startswith("- "))):
                found[key.strip()], i = block(i, lines[i][0])
            else:
                found[key.strip()] = None
        if i < len(lines) and lines[i][0] > depth:
            raise ValueError(f"unexpected indentation: {lines[i][1]}")
        return found, i

    if not lines:
        return {}
    value, end = block(0, lines[0][0])
    if end < len(lines):
        raise ValueError(f"cannot read: {lines[end][1]}")
    return value


def load(root: str | Path) -> ProjectConfig:
    """The project's configuration; the defaults if there is none or it cannot be read."""
    for name in FILE_NAMES:
        path = Path(root) / name
        if path.is_file():
            try:
                return from_dict(parse_yaml(path.read_text(encoding="utf-8")))
            except (ValueError, OSError, AttributeError, TypeError):
                return ProjectConfig()
    return ProjectConfig()


def from_dict(raw: dict) -> ProjectConfig:
    project, context = raw.get("project") or {}, raw.get("context") or {}
    layers = [Layer(x["name"], list(x.get("paths") or []), list(x.get("allowed_imports") or []), x.get("description") or "") for x in raw.get("layers") or []]
    return ProjectConfig(
        project.get("name") or "", project.get("repo") or "", project.get("instructions") or "", list(raw.get("ignore") or []), layers,
        list(raw.get("seed_rules_from") or []), int(context.get("inline_source_max_lines") or 0),
    )


def ignore_patterns(root: str | Path, config: ProjectConfig) -> list[str]:
    """The configured patterns and those of the root's .gitignore."""
    path = Path(root) / ".gitignore"
    return [*config.ignore, *(path.read_text(encoding="utf-8", errors="replace").splitlines() if path.is_file() else [])]


def instruction_facts(root: str | Path, names: tuple[str, ...] = ("CLAUDE.md", ".claude/CLAUDE.md", "CONTRIBUTING.md")) -> dict[str, dict]:
    """Path and size of the instruction files that are there, for the knowledge relation."""
    return {f"instructions_file:{n}": {"path": n, "size": (Path(root) / n).stat().st_size} for n in names if (Path(root) / n).is_file()}
