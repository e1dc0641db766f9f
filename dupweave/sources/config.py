"""Options from project files and settings: tolerant reading, layers, clamping."""

from __future__ import annotations

import json
import math
import os
import re
from dataclasses import dataclass, field, replace

from ..functions import constants as C
from ..functions.globs import rebase, split_patterns

try:
    import yaml
except ImportError:
    yaml = None

# Names of options in files and settings.
PATTERN_LISTS = ("ignore_patterns", "custom_test_patterns", "exclude_test_patterns")
NUMBERS = {"min_tokens": "minTokens", "min_lines": "minLines", "max_indexed_files": "maxIndexedFiles"}
NAMES = {
    "ignore_patterns": ["ignore", "ignorePatterns", "ignore-patterns", "ignore-pattern"],
    "custom_test_patterns": ["customTestPatterns", "custom-test-patterns", "custom_test_patterns", "testPatterns", "test-patterns", "test_patterns"],
    "exclude_test_patterns": ["excludeTestPatterns", "exclude-test-patterns", "exclude_test_patterns"],
    "formats_exts": ["formatsExts", "formats-exts", "formats_exts"],
    "ignore_tests": ["ignoreTests", "ignore-tests", "ignore_tests"],
    "reminder_mode": ["reminderMode"],
}


@dataclass(frozen=True)
class Options:
    min_tokens: int = C.MIN_TOKENS
    min_lines: int = C.MIN_LINES
    max_indexed_files: int = C.MAX_INDEXED_FILES
    ignore_tests: bool = True
    ignore_patterns: tuple[str, ...] = ()
    custom_test_patterns: tuple[str, ...] = ()
    exclude_test_patterns: tuple[str, ...] = ()
    formats_exts: dict[str, list[str]] = field(default_factory=dict)
    reminder_mode: str = "steer"


def parse_relaxed(text: str):
    """JSON with comments, single quotes, bare keys and trailing commas; blank text is None."""
    if not text.strip():
        return None
    parts = re.findall(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//[^\n]*|/\*.*?\*/|[A-Za-z_$][\w$]*|.', text, re.S)
    out = []
    for i, part in enumerate(parts):
        if part.startswith(("//", "/*")):
            continue
        if part[0] == "'" and len(part) > 1:
            part = json.dumps(re.sub(r"\\(['\"])", r"\1", part[1:-1]))
        elif re.fullmatch(r"[A-Za-z_$][\w$]*", part) and re.match(r"\s*:", "".join(parts[i + 1 : i + 9])):
            part = json.dumps(part)
        out.append(part)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", "".join(out)))


def parse_config(text: str, name: str):
    if not text.strip():
        return None
    if name.endswith((".yaml", ".yml")) or name == ".jscpd.rc":
        if name == ".jscpd.rc":
            try:
                return parse_relaxed(text)
            except ValueError:
                pass
        if yaml is None:
            raise ValueError("no YAML reader is installed")
        return yaml.safe_load(text)
    return parse_relaxed(text)


def find_config(cwd: str, root: str, warnings: list[str]) -> tuple[str, dict] | None:
    """(path, values) of the first configuration from `cwd` up to `root`; broken ones are reported and passed over."""
    top, folder = os.path.abspath(root), os.path.abspath(cwd)
    if os.path.commonpath([top, folder]) != top:
        folder = top
    while True:
        for name in C.CONFIG_FILES:
            path = os.path.join(folder, name)
            try:
                with open(path, encoding="utf-8") as f:
                    values = parse_config(f.read(), os.path.basename(path))
            except (FileNotFoundError, NotADirectoryError):
                continue
            except (OSError, ValueError) as e:
                warnings.append(f"{path}: {e}")
                continue
            except Exception as e:
                if yaml is None or not isinstance(e, yaml.YAMLError):
                    raise
                warnings.append(f"{path}: {e}")
                continue
            if name == "package.json":
                values = values.get("jscpd") if isinstance(values, dict) else None
                path += "#jscpd"
            if isinstance(values, dict):
                return path, values
            if values is not None:
                warnings.append(f"{path}: not an object")
        if folder == top or os.path.dirname(folder) == folder:
            return None
        folder = os.path.dirname(folder)


def _number(value) -> float | None:
    try:
        number = float(value) if not isinstance(value, bool) and str(value).strip() else math.nan
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


def read_layer(raw: dict, source: str, warnings: list[str], project: bool = True) -> dict:
    """The known options of one layer; other spellings count in project files only; values that don't fit are reported."""
    layer: dict = {}

    def pick(names: list[str], read):
        value = next((raw[n] for n in names if raw.get(n) is not None), None)
        if value is not None and (got := read(value)) is None:
            warnings.append(f"{source}: {names[0]} is {value!r}")
        elif value is not None:
            return got
        return None

    patterns = lambda v: split_patterns(v) if isinstance(v, str) else [p.strip() for p in v if p.strip()] if isinstance(v, list) and all(isinstance(p, str) for p in v) else None
    flag = lambda v: v if isinstance(v, bool) else {"true": True, "false": False}.get(v.strip().lower()) if isinstance(v, str) else None
    exts = lambda v: {k: x for k, x in v.items() if isinstance(x, list)} if isinstance(v, dict) else None
    for name, camel in NUMBERS.items():
        layer[name] = pick([camel, re.sub("([A-Z])", r"-\1", camel).lower(), name] if project else [camel], _number)
    for name in PATTERN_LISTS:
        layer[name] = pick(NAMES[name] if project else [NAMES[name][1] if name == "ignore_patterns" else NAMES[name][0]], patterns)
    layer["ignore_tests"] = pick(NAMES["ignore_tests"] if project else NAMES["ignore_tests"][:1], flag)
    layer["formats_exts"] = pick(NAMES["formats_exts"], exts) if project else None
    layer["reminder_mode"] = pick(NAMES["reminder_mode"], lambda v: v if v in ("steer", "in-band") else None) if not project else None
    return {k: v for k, v in layer.items() if v is not None}


def merge_layers(layers: list[dict]) -> Options:
    """Later layers win, lists are joined without repeats, maps by key; then numbers are clamped."""
    values: dict = {}
    for layer in layers:
        for name, value in layer.items():
            if name in PATTERN_LISTS:
                values[name] = tuple(dict.fromkeys([*values.get(name, ()), *value]))
            elif name == "formats_exts":
                values[name] = values.get(name, {}) | value
            else:
                values[name] = value
    options = replace(Options(), **values)
    clamped = {n: clamp(getattr(options, n), *C.LIMITS[c]) for n, c in NUMBERS.items()}
    return replace(options, **clamped)


def clamp(value: float, least: int, most: int) -> int:
    return min(most, max(least, math.floor(value)))


def resolve_options(cwd: str, root: str, settings: dict | None = None) -> tuple[Options, str | None, list[str]]:
    """(options, path of the project file, warnings). Patterns of a nested project file are written for the root."""
    warnings: list[str] = []
    layers, path = [], None
    if found := find_config(cwd, root, warnings):
        path, raw = found
        layer = read_layer(raw, path, warnings)
        folder = os.path.dirname(path.removesuffix("#jscpd"))
        folder = os.path.dirname(folder) if os.path.basename(folder) == ".config" else folder
        prefix = os.path.relpath(folder, os.path.abspath(root)).replace(os.sep, "/")
        if prefix != ".":
            layer |= {n: [rebase(p, prefix) for p in layer[n]] for n in PATTERN_LISTS if n in layer}
        layers.append(layer)
    layers.append(read_layer(settings or {}, "settings", warnings, project=False))
    return merge_layers(layers), path, warnings


def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
