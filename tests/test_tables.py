import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from dupweave.operators import fingerprints, ledger, maintenance, matches
from dupweave.plans.index import EDIT, DuplicateIndex
from dupweave.sources import config, repo
from dupweave.sources.config import Options
from dupweave.streaming.ledger_stream import check_stream, first_seen_stream

WORDS = [f"w{i}" for i in range(400)]


def text(a, n, per=6):
    words = WORDS[a : a + n]
    return "\n".join(" ".join(words[i : i + per]) for i in range(0, n, per))


def files(spark, rows):
    return spark.createDataFrame([(f, "txt", t) for f, t in rows.items()], "file string, format string, text string")


def edit(i, file, before, after, kind="content", session="s", seq=0, path=None):
    return (i, session, seq, file, "txt", before, kind, path, after)


def test_new_duplicates_end_to_end(spark):
    corpus = fingerprints.token_table(files(spark, {"a": text(0, 120), "b": text(60, 60), "c": text(300, 60)}))
    edits = spark.createDataFrame([edit(1, "n", None, text(30, 90), "absent"), edit(2, "c", text(300, 60), text(300, 60) + "\n" + text(0, 48)), edit(3, "c", None, text(300, 60), "unknown"), edit(4, "z", None, None, "absent")], EDIT)
    got = {(r.edit_id, r.other_file, r.start_line, r.end_line, r.other_start, r.other_end, r.tokens, r.place) for r in matches.new_duplicates(edits, corpus, 40, 5).collect()}
    assert got == {(1, "a", 1, 15, 6, 20, 90, 1), (2, "a", 11, 18, 1, 8, 48, 1)}


def test_churn_equals_a_fresh_index(spark, tmp_path):
    options = Options(min_tokens=40, min_lines=5)
    churned = DuplicateIndex(spark, options, str(tmp_path / "index"))
    churned.put(files(spark, {"a": text(0, 60), "b": text(0, 60), "c": text(100, 60)}))
    churned.put(files(spark, {"a": text(200, 60)}))
    churned.remove(spark.createDataFrame([("b",)], "file string"))
    fresh = DuplicateIndex(spark, options)
    fresh.put(files(spark, {"a": text(200, 60), "c": text(100, 60)}))
    rows = lambda index: sorted((r.file, tuple(r.hashes)) for r in index.tokens.collect())
    assert rows(churned) == rows(fresh) and churned.get("b").isEmpty()
    probe = spark.createDataFrame([edit(1, "n", None, text(100, 60), "absent")], EDIT)
    assert [r.other_file for r in churned.check(probe).collect()] == ["c"]


def test_edits_in_order_see_earlier_ones(spark, tmp_path):
    index = DuplicateIndex(spark, Options(), str(tmp_path / "index"))
    edits = spark.createDataFrame([edit(1, "x", None, text(0, 60), "absent", seq=1), edit(2, "y", None, text(0, 60), "absent", seq=2), edit(3, "y", None, text(0, 60), "unknown", seq=3)], EDIT)
    assert [(r.edit_id, r.other_file) for r in index.check_in_order(edits).collect()] == [(2, "x")]


def test_check_stream_equals_batches(spark, tmp_path):
    source = str(tmp_path / "edits")
    spark.createDataFrame([edit(1, "x", None, text(0, 60), "absent", seq=1), edit(2, "y", None, text(0, 60), "absent", seq=2)], EDIT).coalesce(1).write.parquet(source)
    index = DuplicateIndex(spark, Options(), str(tmp_path / "index"))
    check_stream(spark.readStream.schema(EDIT).parquet(source), index, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.edit_id, r.other_file) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, "x")]


def test_warning_stream_tells_once(spark, tmp_path):
    from dupweave.streaming.ledger_stream import warning_stream

    source, corpus = str(tmp_path / "edits"), files(spark, {"a": text(0, 120)})
    index = DuplicateIndex(spark, Options(), str(tmp_path / "index"))
    index.put(corpus)
    run = lambda: warning_stream(spark.readStream.schema(EDIT).parquet(source), index, corpus, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "told")).awaitTermination()
    for k in (1, 2):
        spark.createDataFrame([edit(k, "n", None, text(0, 60), "absent", seq=k), edit(k + 10, "n", None, text(0, 60), "absent", f"s{k}", seq=1)], EDIT).coalesce(1).write.mode("append").parquet(source)
        run()
    assert sorted(r.edit_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 11, 12]


LEDGER = [("s", 1, False, "k"), ("s", 2, False, "k"), ("t", 3, False, "k"), ("s", 4, True, "x"), ("s", 5, False, "k"), ("s", 6, False, "l"), ("s", 7, False, "l")]


def test_ledger_and_its_stream(spark, tmp_path):
    df = spark.createDataFrame(LEDGER, "session string, seq long, is_clear boolean, key string")
    batch = {(r.session, r.seq, r.key, r.epoch) for r in ledger.first_seen(df).collect()}
    assert batch == {("s", 1, "k", 0), ("t", 3, "k", 0), ("s", 5, "k", 1), ("s", 6, "l", 1)}
    source = str(tmp_path / "warnings")
    for part in (df.filter("seq <= 2"), df.filter("seq > 2")):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = first_seen_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
    stream.writeStream.format("memory").queryName("ledger_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("ledger_out").collect()} == batch


def test_report_limits(spark):
    m = lambda i, excerpt=None: (1, "f", 1, 9, f"o{i}", 2, 10, 50, f"k{i}", i, excerpt)
    schema = "edit_id long, file string, start_line int, end_line int, other_file string, other_start int, other_end int, tokens int, key string, place int, excerpt string"
    few = ledger.reports(spark.createDataFrame([m(1, "x ``` y"), m(2)], schema)).first()
    assert few.omitted == 0 and few.artifact is None and "~~~~\nx ``` y\n~~~~" in few.text and "f, lines 1 to 9: as in o1, lines 2 to 10 (9 lines)" in few.text
    many = ledger.reports(spark.createDataFrame([m(i) for i in range(6)], schema)).first()
    assert many.omitted == 2 and [x.other_file for x in many.shown] == ["o0", "o1", "o2", "o3"] and "o5" in many.artifact and "(2 more not shown" in many.text
    long = ledger.reports(spark.createDataFrame([m(1, "z" * 9000)], schema)).first()
    assert "z" * 9000 in long.artifact and len(long.text) < 8192 and long.omitted == 0


def test_labels_and_excerpts(spark):
    row = spark.range(1).select(
        ledger.excerpt(F.lit("\n".join(f"l{i}" for i in range(1, 20))), F.lit(2), F.lit(15)).alias("e"), ledger.region_label(F.lit("a"), F.lit(3), F.lit(3)).alias("r"), ledger.match_facts(F.lit(1), F.lit(2)).alias("m"),
        ledger.valid_details(F.lit('{"file":"a","root":"/","omitted":0,"matches":[]}')).alias("v"), ledger.valid_details(F.lit('{"file":"a"}')).alias("w"), ledger.content_text(F.array(F.lit("<note>\nhi\n</note>"))).alias("c"),
        ledger.status_sentence(F.lit("ready"), F.lit(3), F.lit(4), F.lit(1), F.lit(True)).alias("s"),
    ).first()
    assert row.e == "\n".join([f"l{i}" for i in range(2, 10)] + ["… (6 more lines)"]) and row.r == "a:3" and row.m == "1 line · 2 tokens" and row.v and not row.w and row.c == "hi"
    assert row.s == "3 of 4 files indexed, 1 failed (limit reached)"


def test_rescan_keeps_files_written_since_it_began(spark):
    manifest = spark.createDataFrame([("a", 1, 1.0, 0), ("b", 1, 1.0, 5), ("c", 1, 1.0, 0), ("d", 1, 1.0, 9)], "file string, size long, mtime_ms double, rev long")
    listing = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("b", 2, 1.0), ("e", 1, 1.0), ("d", 7, 1.0)], "file string, size long, mtime_ms double")
    got = {r.file: r.action for r in maintenance.rescan_actions(manifest, listing, start_rev=6).collect()}
    assert got == {"a": "same", "b": "changed", "c": "gone", "d": "same", "e": "new"}


def test_options_from_layers(tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / ".jscpd.json").write_text("{// note\n minTokens: '30', 'ignore': ['a.ts', 'x/y',], min_lines: 'many', ignoreTests: 'FALSE'}")
    (tmp_path / "package.json").write_text(json.dumps({"jscpd": {"minLines": 9}}))
    options, path, warnings = config.resolve_options(str(tmp_path / "pkg"), str(tmp_path), {"minTokens": 99999, "ignorePatterns": "z,a/b", "reminderMode": "in-band"})
    assert path.endswith("pkg/.jscpd.json") and len(warnings) == 1 and options.min_tokens == 10_000 and options.min_lines == 5 and options.ignore_tests is False
    assert options.ignore_patterns == ("pkg/**/a.ts", "pkg/x/y", "z", "a/b") and options.reminder_mode == "in-band"
    assert config.resolve_options(str(tmp_path), str(tmp_path))[0].min_lines == 9
    (tmp_path / "package.json").write_text("{broken")
    options, path, warnings = config.resolve_options(str(tmp_path), str(tmp_path))
    assert options == Options() and path is None and len(warnings) == 1


@pytest.fixture
def work_tree(tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    for name, body in {"src/app.ts": "let a = 1", "src/app.test.ts": "x", "big.ts": "x" * 200, "gen.ts": "// @generated", "dist/out.ts": "x", "skipped.ts": "x", ".gitignore": "skipped.ts\n", " lead.ts": "y", "a+b%.ts": "z", "src/__init__.py": "i", "src/_p/_b.py": "b", "src/.eslintrc.js": "c"}.items():
        (root / name).parent.mkdir(exist_ok=True, parents=True)
        (root / name).write_text(body)
    return root


def test_reading_a_work_tree(spark, work_tree):
    root = repo.repo_root(str(work_tree / "src"))
    rows = {r.file: (r.skip_reason, r.text) for r in repo.read_files(spark, root, 100).collect()}
    assert rows["src/app.ts"] == (None, "let a = 1") and rows[" lead.ts"] == (None, "y") and rows["a+b%.ts"] == (None, "z")
    assert rows["src/__init__.py"] == (None, "i") and rows["src/_p/_b.py"] == (None, "b") and rows["src/.eslintrc.js"] == (None, "c")
    assert {k: v[0] for k, v in rows.items() if v[0]} == {"src/app.test.ts": "ignored", "big.ts": "too-large", "gen.ts": "generated", ".gitignore": "unsupported-format"}
    assert repo.relative_path(root, str(work_tree / "src" / "app.ts")) == "src/app.ts" and repo.relative_path(root, "/etc/hosts") is None
    assert repo.repo_root("/nonexistent") is None


def test_only_changed_files_are_opened(spark, work_tree):
    """Files that can't be opened show which ones are."""
    for name in ("dist/out.ts", "big.ts", "src/app.test.ts"):
        (work_tree / name).chmod(0)
    first = repo.read_files(spark, str(work_tree), 100).withColumn("indexed", F.col("skip_reason").isNull()).persist()
    assert {r.skip_reason for r in first.collect()} == {None, "ignored", "too-large", "generated", "unsupported-format"}
    (work_tree / "src" / "app.ts").write_text("let changed = 2")
    (work_tree / "a+b%.ts").unlink()
    again = {r.file: r for r in repo.read_files(spark, str(work_tree), 100, first).collect()}
    assert again["src/app.ts"].text == "let changed = 2" and not again["src/app.ts"].same and again["src/_p/_b.py"].same and again["src/_p/_b.py"].text is None
    assert again["gen.ts"].same and again["gen.ts"].skip_reason == "generated" and "a+b%.ts" not in again or again["a+b%.ts"].skip_reason == "deleted"


def test_project_switches(work_tree, tmp_path):
    state = str(tmp_path / "state" / "projects.json")
    assert repo.is_project_enabled(state, str(work_tree))
    repo.set_project_enabled(state, str(work_tree / "src"), False)
    assert not repo.is_project_enabled(state, str(work_tree)) and repo.is_project_enabled(state, str(tmp_path))
    with open(state, "w") as f:
        f.write("{broken")
    repo.set_project_enabled(state, str(work_tree), True)
    assert repo.is_project_enabled(state, str(work_tree)) and any("broken-" in x for x in os.listdir(os.path.dirname(state)))


def test_pre_images(tmp_path):
    (tmp_path / "f").write_text("x")
    assert repo.read_before(str(tmp_path / "f")) == ("content", "x") and repo.read_before(str(tmp_path / "g")) == ("absent", None) and repo.read_before(str(tmp_path)) == ("unknown", None) and repo.read_before(str(tmp_path / "f"), 0) == ("unknown", None)


def test_stale_caches(tmp_path):
    for name in ("a.sqlite", "a.sqlite-wal", "projects.json", "x.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / ("0" * 16 + "_" + "f" * 16)).mkdir()
    (tmp_path / "kept").mkdir()
    assert repo.remove_stale_caches(str(tmp_path)) == ["0" * 16 + "_" + "f" * 16, "a.sqlite", "a.sqlite-wal"] and sorted(os.listdir(tmp_path)) == ["kept", "projects.json", "x.txt"]
    assert repo.remove_stale_caches(str(tmp_path / "none")) == []


def test_workspace_follows_the_work_tree(spark, work_tree, tmp_path):
    from dupweave.plans import workspace

    body = lambda k: "\n".join(f"call{k}({', '.join(f'name{k}x{i}y{j}' for j in range(4))});" for i in range(12))
    (work_tree / "src" / "one.ts").write_text(body(1))
    w = workspace.acquire(spark, str(work_tree / "src"), str(tmp_path / "state"))
    assert workspace.acquire(spark, str(work_tree), str(tmp_path / "other")) is w and workspace.acquire(spark, "/", str(tmp_path)) is None
    probe = lambda k: spark.createDataFrame([edit(1, "src/new.ts", None, body(k), "absent"), edit(2, "README.md", None, body(k), "absent")], EDIT)
    assert [(r.edit_id, r.other_file) for r in w.check(probe(1)).collect()] == [(1, "src/one.ts")] and w.check(probe(2)).isEmpty()
    before = w.status()
    (work_tree / "src" / "one.ts").write_text(body(2) + "\n")
    (work_tree / "src" / "app.ts").unlink()
    w.refresh()
    after = w.status()
    assert w.check(probe(1)).isEmpty() and [r.other_file for r in w.check(probe(2)).collect()] == ["src/one.ts"]
    assert (before["indexed_files"], after["indexed_files"]) == (9, 7) and "files indexed" in after["sentence"]
    assert workspace.service_stats() == {"workspaces": 1, "ready": 1}
    again = workspace.restart(w)
    with pytest.raises(RuntimeError):
        w.check(probe(1))
    w = again
    state = str(tmp_path / "projects.json")
    assert "is on" in workspace.command("status", state, str(work_tree), w) and "off" in workspace.command("OFF", state, str(work_tree), w) and "is off" in workspace.command("", state, str(work_tree)) and "isn't" in workspace.command("x", state, str(work_tree))
    assert w.state == "unavailable"


def test_captured_pre_images_are_those_of_open_calls(spark):
    """A hundred calls, each answered at once, keep their pre-images; of calls left open the oldest go."""
    calls = [("s", 2 * i, f"c{i}", "f", f"b{i}") for i in range(100)] + [("t", i, f"c{i}", "f", None if i == 20 else f"b{i}") for i in range(70)] + [("u", 5, "c", "f", "late"), ("v", 1, "c", "f", "x")]
    results = [("s", 2 * i + 1, f"c{i}", "f") for i in range(100)] + [("t", 100 + i, f"c{i}", "f") for i in range(70)] + [("u", 4, "c", "f"), ("u", 6, "c", "f"), ("u", 7, "c", "f"), ("v", 2, "c", "g")]
    c = spark.createDataFrame(calls, "session string, seq long, call_id string, file string, before string")
    r = spark.createDataFrame(results, "session string, seq long, call_id string, file string")
    got = {(x.session, x.seq): (x.before, x.before_kind) for x in maintenance.captured_befores(c, r, 64).collect()}
    assert all(got["s", 2 * i + 1] == (f"b{i}", "content") for i in range(100))
    assert [got["t", 100 + i][1] for i in range(70)] == ["unknown"] * 6 + ["content"] * 14 + ["absent"] + ["content"] * 49
    assert [got["u", k] for k in (4, 6, 7)] == [(None, "unknown"), ("late", "content"), (None, "unknown")] and got["v", 2] == (None, "unknown")


def test_requests_of_tool_results(spark):
    schema = "session string, seq long, tool string, is_error boolean, resolved_path string, edits array<struct<path:string,source_path:string,is_error:boolean>>, before string, before_kind string, captured_path string"
    rows = [("s", 1, "write", False, "/a", None, "x", "content", "/a"), ("s", 2, "write", False, "/a", None, "x", "content", "/b"), ("s", 3, "write", True, "/a", None, None, None, None), ("s", 4, "edit", False, None, [("/c", "/d", False), ("/e", None, True)], None, None, None), ("s", 5, "bash", False, "/a", None, None, None, None), ("s", 6, "write", False, "", None, None, None, None)]
    got = {(r.seq, r.at): (r.file, r.before, r.before_kind, r.before_path) for r in maintenance.mutation_requests(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 0): ("/a", "x", "content", None), (2, 0): ("/a", None, "unknown", None), (4, 0): ("/c", None, "unknown", "/d"), (4, 1): ("/d", None, "unknown", None)}


def test_events_to_edits(spark, tmp_path):
    from dupweave.sources import events

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.ts").write_text("old")
    (root / "b.ts").write_text("b text")
    a = str(root / "a.ts")
    rows = [
        {"session": "s", "seq": 1, "name": "tool_call", "call_id": "1", "tool": "write", "path": a},
        {"session": "s", "seq": 2, "name": "tool_result", "call_id": "1", "tool": "write", "resolved_path": a},
        {"session": "s", "seq": 3, "name": "tool_result", "call_id": "2", "tool": "edit", "edits": [{"path": "b.ts", "source_path": "c.ts"}, {"path": "x.ts", "is_error": True}]},
        {"session": "s", "seq": 4, "name": "tool_result", "call_id": "3", "tool": "bash"},
        {"session": "s", "seq": 5, "name": "tool_result", "call_id": "4", "tool": "read"},
        {"session": "s", "seq": 6, "name": "session_switch"},
        {"session": "s", "seq": 7, "name": "tool_result", "call_id": "9", "tool": "write", "resolved_path": "/elsewhere/f.ts"},
    ]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    e = events.read_events(spark, str(tmp_path / "log"))
    calls = events.captured_calls(e).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else spark.createDataFrame(events.captured_calls(e).collect(), "session string, seq long, call_id string, file string, before string, kind string")
    (root / "a.ts").write_text("new")
    got = {(r.seq, r.file): (r.before, r.before_kind, r.before_path, r.after) for r in events.edits_of(events.requests(e, calls), str(root)).collect()}
    assert got == {(2000, "a.ts"): ("old", "content", None, "new"), (3000, "b.ts"): (None, "unknown", "c.ts", "b text"), (3001, "c.ts"): (None, "unknown", None, None)}
    assert [(r.session, r.seq) for r in events.clears(e).collect()] == [("s", 6)] and [r.seq for r in events.rescans(e).collect()] == [4]
    assert events.read_event_stream(spark, str(tmp_path / "log")).isStreaming


def test_a_session_is_warned_once(spark, tmp_path):
    """Check, ledger and report together: a copy is told once, again after a clearing, and in another session."""
    from dupweave.plans import warnings

    corpus = files(spark, {"a": text(0, 120), "b": text(200, 80)})
    tokens = fingerprints.token_table(corpus)
    e = [edit(1, "n", None, text(0, 60), "absent", "s", 1), edit(2, "n", None, text(0, 60), "absent", "s", 2), edit(3, "n", text(0, 60), text(0, 60) + "\n" + text(200, 60), "content", "s", 3), edit(4, "n", None, text(0, 60), "absent", "s", 5), edit(5, "n", None, text(0, 60), "absent", "t", 1)]
    clears = spark.createDataFrame([("s", 4)], "session string, seq long")
    got = {r.edit_id: r for r in warnings.session_warnings(spark.createDataFrame(e, EDIT), tokens, corpus, clears, 40, 5).collect()}
    assert sorted(got) == [1, 3, 4, 5] and "as in a, lines 1 to 10" in got[1].text and "w0 w1 w2" in got[1].text and "as in b" in got[3].text and "as in a" not in got[3].text
    assert all(r.delivery == "in-band" for r in got.values())


def test_progress_is_throttled():
    from types import SimpleNamespace as Event

    from dupweave.streaming.progress import ProgressStatus

    said = []
    status = ProgressStatus(said.append, interval=60)
    status.onQueryStarted(Event(runId="r"))
    for n in (3, 4):
        status.onQueryProgress(Event(progress=Event(runId="r", numInputRows=n)))
    status.onQueryTerminated(Event(runId="r", exception=None))
    assert said == ["started", "3 rows checked", "done after 7 rows"]
