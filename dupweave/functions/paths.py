"""Predicates on repository paths, as columns that Spark evaluates within its scans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .globs import Rule, compile_rules, expand_braces, ignored, rules_regex


def is_repo_relative(path: Column) -> Column:
    return ~path.rlike(r"^$|^\.{1,2}$|^\.{0,2}/|/$")


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """With its dot; empty for names that only begin with a dot."""
    return F.regexp_extract(base_name(path), r"^.+?(\.[^.]*)$|^.*[^.].*(\.[^.]*)$", 1)


def in_ignored_folder(path: Column) -> Column:
    return F.arrays_overlap(folders(path), F.array(*map(F.lit, C.IGNORED_DIRS)))


def matches_rules(path: Column, rules: list[Rule]) -> Column:
    """Whether ignore rules take the path: one regular expression, or for rules that keep paths again an Arrow function."""
    if not rules:
        return F.lit(False)
    if not any(r.keeps for r in rules):
        return path.rlike(rules_regex(rules))

    @F.arrow_udf("boolean")
    def taken(paths: pa.Array) -> pa.Array:
        return pa.array([p is not None and ignored(rules, p) for p in paths.to_pylist()], pa.bool_())

    return taken(path)


def detect_format(path: Column, formats_exts: dict[str, list[str]] | None = None) -> Column:
    """The format by extension; null if it isn't code. Extensions named in `formats_exts` come first and always count."""
    known = {e: f for f, names in C.FORMAT_EXTENSIONS.items() for e in names.split()}
    code = {e: f for e, f in known.items() if f not in C.NON_CODE_FORMATS and not (f == "markup" and e in C.NON_CODE_MARKUP_EXTS)}
    formats = F.map_from_arrays(F.array(*map(F.lit, code)), F.array(*map(F.lit, code.values())))

    def named(ext: Column) -> Column:
        # An exact extension counts before its lower-case form, also where it makes the path no code.
        out = F.when(ext == "", F.lit(None).cast("string"))
        for name, names in (formats_exts or {}).items():
            if name in C.FORMAT_EXTENSIONS:
                out = out.when(ext.isin(names) | F.lower(ext).isin(names), name)
        found = F.when(ext.isin(list(known)), ext).otherwise(F.lower(ext))
        return out.when(~F.lower(ext).isin(C.NON_CODE_MARKUP_EXTS), F.try_element_at(formats, found))

    return F.transform(F.array(F.substring(extension(path), 2, 1000)), named)[0]


def is_default_test(path: Column) -> Column:
    """The ordered rules for test paths of many ecosystems."""

    def judged(x: Column) -> Column:
        ext, base, dirs = x["ext"], x["base"], x["dirs"]
        name = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
        structured = F.lit(False)
        for pattern in C.TEST_PATHS:
            structured = structured | x["path"].rlike(pattern)
        return (
            F.when(ext.isin(C.TEST_EXTENSIONS), True)
            .when(F.lower(base).isin(C.TEST_HELPERS), True)
            .when(F.arrays_overlap(F.transform(dirs, lambda d: F.lower(d)), F.array(*map(F.lit, C.TEST_DIRECTORIES))), True)
            .when((F.size(F.filter(dirs, lambda d: d != "")) > 0) & structured, True)
            .when(name == "", False)
            .when(name.rlike(C.NOT_TESTS), False)
            .otherwise(base.rlike(C.TEST_PREFIX) | name.rlike(C.TEST_PASCAL_PREFIX) | name.rlike(C.TEST_SUFFIX) | name.rlike(C.TEST_PASCAL_SUFFIX))
        )

    # A one-element array gives the parts names, so that each is computed once.
    parts = F.struct(path.alias("path"), F.lower(extension(path)).alias("ext"), base_name(path).alias("base"), folders(path).alias("dirs"))
    return F.transform(F.array(parts), judged)[0]


def is_test(path: Column, ignore_tests: bool = True, custom: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Excluded patterns come first, then custom ones, then the default rules; null and empty paths are no tests."""
    if not ignore_tests:
        return F.lit(False)
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    expanded = lambda patterns: compile_rules([e for p in patterns or [] for e in expand_braces(p)])
    relative = ~plain.startswith("/")
    usual = is_default_test(plain)
    return (
        F.when(path.isNull() | plain.isin("", "."), False)
        .when(relative & matches_rules(plain, expanded(exclude)), False)
        .when(relative & matches_rules(plain, expanded(custom)), True)
        .otherwise(usual)
    )


def path_verdict(path: Column, ignore_patterns: list[str] | None = None, ignore_tests: bool = True, custom: list[str] | None = None, exclude: list[str] | None = None, formats_exts: dict[str, list[str]] | None = None) -> Column:
    """(format, reason): the first reason against the path in a fixed order, or its format."""
    rules = compile_rules([*C.NOISE_PATTERNS, *(e for p in ignore_patterns or [] for e in expand_braces(p))])
    odd = path.rlike(r"(?:^|/)\.{3,}(?:/|$)")
    outside = path.isNull() | ~is_repo_relative(path) | in_ignored_folder(path)
    unwanted = odd | matches_rules(path, rules) | is_test(path, ignore_tests, custom, exclude)
    verdict = lambda format_, reason: F.struct(format_.alias("format"), reason.alias("reason"))
    none = F.lit(None).cast("string")

    def judged(x: Column) -> Column:
        return F.when(x["format"].isNull(), verdict(none, F.lit("unsupported-format"))).when(x["unwanted"], verdict(none, F.lit("ignored"))).otherwise(verdict(x["format"], none))

    # A one-element array gives the format a name, so that it is computed once.
    named = F.array(F.struct(detect_format(path, formats_exts).alias("format"), unwanted.alias("unwanted")))
    return F.when(outside, verdict(none, F.lit("ignored"))).otherwise(F.transform(named, judged)[0])


def is_generated(text: Column) -> Column:
    """Whether a comment in the head of `text` carries a mark of generated content: a fold over the head's lines."""
    lines = F.split(F.substring(text, 1, C.GENERATED_HEADER_CHARS), "\n")

    def step(state: Column, line: Column) -> Column:
        bare = F.ltrim(line)
        opener = F.lit("")
        closes = F.lit(False)
        for begin, end in reversed(C.BLOCK_COMMENTS):
            starts = bare.startswith(begin)
            opener = F.when(starts, end).otherwise(opener)
            closes = F.when(starts, F.contains(F.substring(bare, F.lit(len(begin) + 1), F.length(bare)), F.lit(end))).otherwise(closes)
        inside = state["closer"] != ""
        comment = inside | (opener != "") | bare.rlike(C.LINE_COMMENT)
        closer = F.when(inside, F.when(F.contains(line, state["closer"]), "").otherwise(state["closer"])).otherwise(F.when(closes, "").otherwise(opener))
        return F.struct(closer.alias("closer"), (state["found"] | (comment & line.rlike(C.GENERATED_MARKER))).alias("found"))

    return F.aggregate(lines, F.struct(F.lit("").alias("closer"), F.lit(False).alias("found")), step, lambda s: s["found"])


def skip_reason(text: Column, most_bytes: int = C.MAX_FILE_BYTES) -> Column:
    return F.when(text.isNull(), "deleted").when(F.octet_length(text) > most_bytes, "too-large").when(is_generated(text), "generated")


def tool_path(path: Column, home: str = "/home/user") -> Column:
    """A path given to a tool: null if blank or like a URL; a leading `~` is the home folder."""
    bare = F.trim(path)
    return F.when((bare != "") & ~bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_replace(bare, r"^~(?=/|$)", home))
