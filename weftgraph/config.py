"""Settings of an analysis, read from a properties file: lists, relative paths, patterns and what is wrong with them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from weftgraph.functions.names import pattern_problem

_LISTS = {"source_folders", "library_paths", "exclude_packages", "entry_methods", "call_rules"}
_PATHS = {"project_root", "output_folder", "source_folders", "library_paths", "call_rules"}
_PATTERNS = {"exclude_packages", "entry_methods"}


@dataclass
class EngineConfig:
    """Keys of the file are the names here with dots for underscores; unknown ones are kept in `other`."""

    project_root: str = "."
    source_folders: list[str] = field(default_factory=lambda: ["src"])
    library_paths: list[str] = field(default_factory=list)
    output_folder: str = "output"
    output_encoding: str = "UTF-8"
    output_bom: bool = True
    exclude_packages: list[str] = field(default_factory=list)
    entry_methods: list[str] = field(default_factory=list)
    call_rules: list[str] = field(default_factory=list)
    max_depth: int = 50
    max_rows: int = 5_000_000
    expand_max_candidates: int = 3
    dataflow_max_depth: int = 5
    other: dict[str, str] = field(default_factory=dict)

    def problems(self) -> list[tuple[str, str, str]]:
        """(setting, pattern, problem) of patterns that can't match as written."""
        return [(name, p, problem) for name in sorted(_PATTERNS) for p in getattr(self, name) if (problem := pattern_problem(p))]


def parse_properties(text: str) -> dict[str, str]:
    """Keys and values of a properties file: # and ! begin notes, a backslash at a line's end goes on, \\uXXXX and the usual escapes count."""
    lines, open_ = [], ""
    for raw in text.splitlines():
        line = open_ + raw.lstrip() if open_ else raw.lstrip()
        if not open_ and (not line or line[0] in "#!"):
            continue
        if len(line) - len(line.rstrip("\\")) & 1:
            open_ = line[:-1]
            continue
        lines.append(line)
        open_ = ""
    if open_:
        lines.append(open_)
    simple = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}

    def plain(x: str) -> str:
        return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else simple.get(m[2], m[2]), x, flags=re.S)

    out = {}
    for line in lines:
        m = re.match(r"((?:\\.|[^=:\s\\])*)\s*[=:]?\s*(.*)$", line, re.S)
        out[plain(m[1])] = plain(m[2])
    return out


def read_config(path: str) -> EngineConfig:
    """The settings of a file. Relative paths are taken from the project's root, the root from the file's folder; list items are parted
    by commas or semicolons. A number or flag that isn't one fails with the setting's name."""
    given, config = parse_properties(Path(path).read_text(encoding="utf-8")), EngineConfig()
    known = {f.name: f for f in fields(EngineConfig) if f.name != "other"}
    for key, value in given.items():
        name = key.strip().replace(".", "_").replace("-", "_")
        if name not in known:
            config.other[key] = value
        elif name in _LISTS:
            setattr(config, name, [x.strip() for x in re.split("[,;]", value) if x.strip()])
        elif isinstance(known[name].default, bool):
            if value.strip().lower() not in ("true", "false"):
                raise ValueError(f"{key} is neither true nor false: {value}")
            setattr(config, name, value.strip().lower() == "true")
        elif isinstance(known[name].default, int):
            if not re.fullmatch(r"\s*[0-9]+\s*", value):
                raise ValueError(f"{key} is not a number: {value}")
            setattr(config, name, int(value))
        else:
            setattr(config, name, value.strip())
    root = (Path(path).parent / config.project_root).resolve()
    config.project_root = str(root)
    for name in _PATHS - {"project_root"}:
        now = getattr(config, name)
        setattr(config, name, [str((root / x).resolve()) for x in now] if isinstance(now, list) else str((root / now).resolve()))
    return config
