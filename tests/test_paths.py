import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dupweave.functions import globs, paths

TESTS = """src/user.test.ts src/__tests__/a.js apps/web/src/__tests__/Button.test.tsx packages/core/src/test/java/com/example/CoreTest.java
services/auth/tests/test_token.py modules/payment/test/payment_test.go android/app/src/androidTest/java/com/example/AppTest.kt
ios/MyAppTests/MyAppTests.swift backend/dotnet/App.Tests/Controllers/AuthControllerTests.cs SRC/TEST/App.java Tests/Unit/Parser.php
SPEC/models/user_spec.rb conftest.py TestUser.java ITOrder.java PaymentIT.java x.bats a/b.snap sort_bench.go lib/test_helper.rb""".split()
OTHERS = """src/auth/attestation.ts src/auth/Attestation.java src/contest/voting.ts src/models/Contest.java src/utils/latest.ts src/utils/fastest.py
src/context.ts src/contextual/parser.ts src/biology/testosterone.ts src/legal/intestate.py src/services/UserService.java src/lib/database.go""".split()


def one(spark, column_of, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p string")
    return [r.x for r in df.select("i", column_of(F.col("p")).alias("x")).orderBy("i").collect()]


def test_test_paths(spark):
    assert one(spark, paths.is_test, [*TESTS, *OTHERS, "", "   ", ".", None]) == [True] * len(TESTS) + [False] * (len(OTHERS) + 4)


def test_options_for_tests(spark):
    assert one(spark, lambda p: paths.is_test(p, ignore_tests=False), ["src/user.test.ts"]) == [False]
    assert one(spark, lambda p: paths.is_test(p, custom=["src/custom/**"]), ["src/custom/helper.ts"]) == [True]
    assert one(spark, lambda p: paths.is_test(p, exclude=["src/Button.test.ts"]), ["src/Button.test.ts", ".\\src\\Button.test.ts"]) == [False, False]


def test_verdicts_in_order(spark):
    cases = {
        "src/app.ts": ("typescript", None), "README.md": (None, "unsupported-format"), "tests/README.md": (None, "unsupported-format"), "target/debug/out.rs": (None, "ignored"),
        "a/node_modules/b/c.js": (None, "ignored"), "src/app.test.ts": (None, "ignored"), "lib.min.js": (None, "ignored"), "/abs.ts": (None, "ignored"), "dir/": (None, "ignored"), "icon.svg": (None, "unsupported-format"),
        "page.html": ("markup", None), " leading.ts": ("typescript", None), "space dir /trailing.ts": ("typescript", None), "a/.../b.ts": (None, "ignored"),
    }
    got = one(spark, paths.path_verdict, [*cases, None])
    assert [tuple(x) for x in got] == [*cases.values(), (None, "ignored")]


def test_ignore_patterns_with_braces_and_exceptions(spark):
    verdict = lambda *patterns: lambda p: paths.path_verdict(p, list(patterns))["reason"]
    assert one(spark, verdict("**/*.{gen,tmp}.ts"), ["src/a.gen.ts", "b.tmp.ts", "src/keep.ts"]) == ["ignored", "ignored", None]
    assert one(spark, verdict("*.ts", "!keep.ts"), ["src/a.ts", "src/keep.ts"]) == ["ignored", None]
    assert one(spark, verdict("gen/", "!gen/keep.ts"), ["gen/keep.ts", "src/gen/x.ts", "gen.ts"]) == ["ignored", "ignored", None]


def test_formats_that_are_opted_in(spark):
    assert one(spark, lambda p: paths.detect_format(p, {"markdown": ["md"], "unknown": ["zz"]}), ["a.md", "a.MD", "a.zz", "a.json", "x.R", "x.TS"]) == ["markdown", "markdown", None, None, "r", "typescript"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("// Code generated by protoc. DO NOT EDIT.\npackage x\n", True), ("/*\n * Generated by OpenAPI.\n */\nexport {}\n", True), ('"""\nAutogenerated module.\n"""\nx = 1\n', True), ("# @generated\nx = 1\n", True),
        ("const marker = /@generated/;\nexport {};\n", False), ("// filler\n" * 300 + "// @generated\n", False), ("/* a */ x\n@generated", False), ("", False),
    ],
)
def test_generated_heads(spark, text, expected):
    assert one(spark, paths.is_generated, [text]) == [expected]


def test_skip_reasons_in_order(spark):
    assert one(spark, lambda t: paths.skip_reason(t, 20), ["// @generated" + "x" * 20, "// @generated", "plain", "é" * 11, None]) == ["too-large", "generated", None, "too-large", "deleted"]


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [("a{b,c}d", ["abd", "acd"]), ("{a,b{c,d}}", ["a", "bc", "bd"]), ("{x}", ["{x}"]), (r"\{a,b}", [r"\{a,b}"]), ("{a}{b,c}", ["{a}b", "{a}c"]), ("a,b", ["a,b"]), ("{a,}", ["a", ""]), ("{a", ["{a"])],
)
def test_braces(pattern, expected):
    assert globs.expand_braces(pattern) == expected


def test_lists_and_rebasing():
    assert globs.split_patterns("a, b.{ts,tsx} ,,c}") == ["a", "b.{ts,tsx}", "c}"]
    assert globs.split_patterns("") == []
    assert [globs.rebase(p, "pkg") for p in ("*.ts", "/a/b", "a/", "!x", "# c", "a/b/")] == ["pkg/**/*.ts", "pkg/a/b", "pkg/**/a/", "!pkg/**/x", "# c", "pkg/a/b/"]


@given(st.lists(st.sampled_from(["a", "b", "x.ts", "gen", "c d"]), min_size=1, max_size=4))
def test_the_one_regex_and_the_walk_over_folders_agree(parts):
    import re

    path = "/".join(parts)
    rules = globs.compile_rules(["gen/", "*.ts", "a/b", "c?d/**", "**/x.ts", "b/**/x*"])
    assert globs.ignored(rules, path) == bool(re.search(globs.rules_regex(rules), path))
