"""Ignore patterns: brace expansion, list splitting, re-anchoring, and matching by compiled regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass


def _top_level_commas(body: str) -> list[str]:
    """`body` cut at its commas outside braces; a backslash protects the next character."""
    parts, depth, word, escaped = [], 0, "", False
    for c in body:
        if not escaped and c == "," and depth == 0:
            parts.append(word)
            word = ""
            continue
        if not escaped:
            depth += (c == "{") - (c == "}" and depth > 0)
        escaped = c == "\\" and not escaped
        word += c
    return [*parts, word]


def _first_group(pattern: str) -> tuple[int, int, list[str]] | None:
    """The first brace group at the top level that has alternatives: where it begins and ends, and its parts."""
    depth = begin = 0
    skip = False
    for i, c in enumerate(pattern):
        if skip or c == "\\":
            skip = not skip
        elif c == "{":
            begin = i if depth == 0 else begin
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0 and len(parts := _top_level_commas(pattern[begin + 1 : i])) > 1:
                return begin, i + 1, parts
    return None


def expand_braces(pattern: str) -> list[str]:
    """`a{b,c}d` as `abd`, `acd`; groups nest, `\\{` is a plain brace and `{x}` without a comma stays."""
    group = _first_group(pattern)
    if group is None:
        return [pattern]
    begin, end, parts = group
    return [done for part in parts for done in expand_braces(pattern[:begin] + part + pattern[end:])]


def split_patterns(value: str) -> list[str]:
    """A comma-separated list; commas in braces don't separate, blanks go."""
    parts, depth, word = [], 0, ""
    for c in value + ",":
        depth += (c == "{") - (c == "}" and depth > 0)
        if c == "," and (depth == 0 or len(word) + sum(map(len, parts)) + len(parts) == len(value)):
            parts.append(word)
            word = ""
        else:
            word += c
    return [p.strip() for p in parts if p.strip()]


def rebase(pattern: str, prefix: str) -> str:
    """A pattern of the folder `prefix`, written for the root."""
    if not pattern or pattern[0] == "#":
        return pattern
    if pattern[0] == "!":
        return "!" + rebase(pattern[1:], prefix)
    if "/" in pattern.rstrip("/"):
        return f"{prefix}/{pattern.lstrip('/')}"
    return f"{prefix}/**/{pattern}"


def _body_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob[i:] == "**" and i and glob[i - 1] == "/":
            return out + ".+"
        if c == "*":
            out += "[^/]*"
            while glob.startswith("*", i + 1):
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (close := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = close
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


@dataclass(frozen=True)
class Rule:
    """One pattern: `regex` matches a path, with a slash at its end if it is a folder."""

    regex: str
    keeps: bool


def compile_rules(patterns: list[str] | None) -> list[Rule]:
    rules = []
    for line in patterns or []:
        line = line.rstrip() if not line.rstrip().endswith("\\") else line
        if not line or line[0] == "#":
            continue
        keeps = line[0] == "!"
        body = line[1:] if keeps else line
        folder = body.endswith("/")
        anchored = "/" in body.rstrip("/")
        body = body.strip("/") if anchored or folder else body
        if body:
            head = "^" if anchored else "^(?:.*/)?"
            rules.append(Rule(f"{head}{_body_regex(body)}{'/' if folder else '/?'}$", keeps))
    return rules


def ignored(rules: list[Rule], path: str) -> bool:
    """Whether the last rule that matches the path ignores it, or ignores a folder that holds it. Case doesn't matter."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        name = "/".join(parts[:n]) + ("/" if n < len(parts) else "")
        state = False
        for rule in rules:
            if re.match(rule.regex, name, re.I):
                state = not rule.keeps
        if state:
            return True
    return False


def rules_regex(rules: list[Rule]) -> str | None:
    """One regular expression for rules that never keep: a match of the path or of a folder that holds it."""
    if any(r.keeps for r in rules):
        raise ValueError("rules that keep paths depend on their order")
    ends = [r.regex[:-3] + "(?:/|$)" if r.regex.endswith("/?$") else r.regex[:-1] for r in rules]
    return "(?i)" + "|".join(f"(?:{e})" for e in ends) if ends else None
