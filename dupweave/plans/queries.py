"""The engine's registered queries and their SQL."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import globs, hashing, paths
from ..operators import diff, fingerprints, ledger, maintenance, matches, runs
from ..sources import config
from . import corpus, warnings
from .corpus import table
from .sql import SQL

PROBE_TOKENS = 20
SHORT_TOKENS = 10


def _per_stream(tokens: DataFrame, schema: str, names: list[str], values) -> DataFrame:
    """Rows of (file, values of its stream) from the token table; `values` gives a tuple for (hashes, start lines)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [values(h, s) for h, s in zip(fingerprints.list_arrays(batch.column(1)), fingerprints.list_arrays(batch.column(2)), strict=True)]
            columns = list(zip(*found, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c)) if found else pa.array([], pa.int64()) for c in columns)], names=["file", *names])

    return tokens.select("file", "hashes", "start_lines").mapInArrow(run, f"file string, {schema}")


def first_places(values: np.ndarray) -> np.ndarray:
    """For each value the place of the first equal one: what a stream of hashes says apart from the hash in use."""
    _, first, which = np.unique(values, return_index=True, return_inverse=True)
    return first[which] if len(values) else np.zeros(0, np.int64)


def _digest(parts) -> str:
    return hashlib.md5(" ".join(parts).encode()).hexdigest()


def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    """The engine's token streams: number of tokens, and a digest of each one's line and the place of the first equal one."""
    values = lambda h, s: (len(h), _digest(f"{line}:{first}" for line, first in zip(s.tolist(), first_places(h).tolist(), strict=True)))
    tokens = fingerprints.token_table(corpus.document_files(spark, d))
    return _per_stream(tokens, "n_tokens long, digest string", ["n_tokens", "digest"], values).select(F.col("file").cast("long").alias("doc_id"), "n_tokens", "digest")


def token_hash(spark: SparkSession, d: str) -> DataFrame:
    tokens = fingerprints.exploded_tokens(table(spark, d, "benchmark"), "item_id").select("token").distinct()
    return tokens.select("token", hashing.token_hash(F.lit("word"), F.col("token")).alias("hash"))


def line_spans(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    longest = F.array_max(F.transform("lines", lambda x: F.length(x)))
    return table(spark, d, "documents").select("doc_id", lines.alias("lines")).select("doc_id", F.size("lines").cast("long").alias("n_lines"), longest.cast("long").alias("longest"), F.size(F.filter("lines", lambda x: F.trim(x) == "")).cast("long").alias("blank"))


def block_streams(spark: SparkSession, d: str) -> DataFrame:
    """Token streams of web pages: separators stand between a page's own text, scripts and styles."""
    return fingerprints.token_table(corpus.page_files(spark, d)).select("file", F.size("hashes").cast("long").alias("n_tokens"), F.size(F.filter("hashes", lambda h: h == C.SEPARATOR)).cast("long").alias("n_separators"))


def size_filter(spark: SparkSession, d: str) -> DataFrame:
    most = 20_000
    return table(spark, d, "documents").select("doc_id", F.when(F.octet_length("text") > most, "too-large").alias("reason"))


HEADERS = ["// @generated by tool\ncode", "/* Auto-generated.\n */ x", "x = 1\n# DO NOT EDIT", "# hello\nprint('do not edit')", "/*\nfirst\nautogenerated\n*/", "/* a */ x\nauto-generated", '"""\nGenerated by hand\n"""', "<!--\nautomatically generated\n-->"]


def generated_filter(spark: SparkSession, d: str) -> DataFrame:
    heads = spark.range(1).select(F.posexplode(F.array(*map(F.lit, HEADERS))).alias("n", "text")).select(F.concat(F.lit("head"), F.col("n").cast("string")).alias("name"), "text")
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "text")
    return heads.unionByName(docs).select("name", paths.is_generated(F.coalesce("text", F.lit(""))).alias("is_generated"))


def path_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.path_table(spark, d)
    v = paths.path_verdict(F.col("path"), ignore_patterns=["docs/", "*.{zig,sql}"])
    return rows.select("path", v.alias("v")).select("path", "v.format", "v.reason")


def test_path_flag(spark: SparkSession, d: str) -> DataFrame:
    return corpus.path_table(spark, d).select("path", paths.is_test(F.col("path"), custom=["lib/**/deep.*"], exclude=["e2e/"]).alias("is_test"))


def format_detect(spark: SparkSession, d: str) -> DataFrame:
    return corpus.path_table(spark, d).select("path", paths.detect_format(F.col("path"), {"markdown": ["md"], "json": ["json"]}).alias("format"))


def content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(maintenance.content_key(F.col("lang"), F.col("text")).alias("content_key")).agg(F.count(F.lit(1)).alias("n_files"), F.min("doc_id").alias("first_id"))


def kgram_hash(spark: SparkSession, d: str) -> DataFrame:
    """The engine's hashes of 5 tokens over all documents: their number, and a digest of the places of first equal ones."""
    k, _ = fingerprints.gram_and_window(SHORT_TOKENS)
    values = lambda h, _: (len(g := fingerprints.gram_hashes(h, k)), _digest(map(str, first_places(g).tolist())))
    return _per_stream(fingerprints.token_table(corpus.document_files(spark, d)), "n_grams long, digest string", ["n_grams", "digest"], values)


def winnow_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The engine's fingerprints of all documents hold one of each window; which one depends on the hash alone.

    Per document: its windows, those without a fingerprint, and fingerprints that differ from the gram at their place.
    """
    k, w = fingerprints.gram_and_window(SHORT_TOKENS)

    def values(h, _):
        grams, (fps, places) = fingerprints.gram_hashes(h, k), fingerprints.winnow(h, k, w)
        chosen = np.concatenate(([0], np.cumsum(np.bincount(places, minlength=len(grams))[: len(grams)])))
        windows = max(0, len(grams) - w + 1)
        bare = int((chosen[w:][:windows] == chosen[:windows]).sum()) if windows else 0
        return windows, bare, int((grams[places] != fps).sum())

    return _per_stream(fingerprints.token_table(corpus.document_files(spark, d)), "windows long, bare long, wrong long", ["windows", "bare", "wrong"], values)


def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    """The index's postings over all documents, for runs of one token: number of places and the first of them for each fingerprint."""
    found = fingerprints.fingerprint_table(fingerprints.token_table(corpus.document_files(spark, d)), 1)
    listed = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"), F.min(F.struct("file", "pos")).alias("first"))
    return listed.select(F.col("first.file").alias("first_file"), F.col("first.pos").cast("long").alias("first_pos"), "n", "n_files")


def cross_runs(spark: SparkSession, d: str) -> DataFrame:
    """All maximal runs of at least 40 tokens between two documents."""
    found = runs.cross_runs(corpus.document_files(spark, d), keep=corpus.kept)
    return found.select("file", "other_file", F.col("region").cast("long").alias("region"), F.col("other").cast("long").alias("other"), F.col("len").cast("long").alias("len"))


def _probe_runs(spark: SparkSession, d: str) -> DataFrame:
    probes = corpus.kept(fingerprints.token_table(corpus.benchmark_files(spark, d)))
    return runs.runs_against(probes, corpus.document_tokens(spark, d), PROBE_TOKENS)


def benchmark_contamination(spark: SparkSession, d: str) -> DataFrame:
    return _probe_runs(spark, d).select("file", "other_file", *[F.col(c).cast("long").alias(c) for c in ("region", "other", "len")])


def _page_runs(spark: SparkSession, d: str, most: int) -> DataFrame:
    pages = corpus.page_files(spark, d).withColumn("format", F.lit("txt"))
    found = runs.self_runs(fingerprints.token_table(pages), SHORT_TOKENS, most)
    return found.select("file", *[F.col(c).cast("long").alias(c) for c in ("region", "other", "len")])


def self_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least 10 tokens within a page's source, from the first 128 places of each fingerprint."""
    return _page_runs(spark, d, C.MAX_SELF_OCCURRENCES)


def self_runs_all(spark: SparkSession, d: str) -> DataFrame:
    """The same from all places."""
    return _page_runs(spark, d, 1 << 30)


def trim_partial_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole-line parts of the runs between benchmark items and documents, of any length left."""
    found = _probe_runs(spark, d).select("file", "region", "len").distinct()
    lines = fingerprints.token_table(corpus.benchmark_files(spark, d)).select("file", "start_lines", "end_lines")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            starts, ends = fingerprints.list_arrays(batch.column(3)), fingerprints.list_arrays(batch.column(4))
            trimmed = [matches.trim_partial_lines(s, e, r, n) for s, e, r, n in zip(starts, ends, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([int(t[0]) for t in trimmed], pa.int64()), pa.array([int(t[1]) for t in trimmed], pa.int64())], names=["file", "region", "len", "start", "left"])

    out = found.join(lines, "file").mapInArrow(run, "file string, region int, len int, start long, left long")
    return out.select("file", F.col("region").cast("long").alias("region"), F.col("len").cast("long").alias("len"), "start", "left")


def append_edit_new_tokens(spark: SparkSession, d: str) -> DataFrame:
    """New tokens of edits that add the second half of a document's lines to the first."""
    docs = table(spark, d, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    half = F.array_join(F.slice(lines, F.lit(1), F.ceil(F.size(lines) / 2).cast("int")), "\n")
    rows = docs.select("doc_id", F.col("text").alias("after"), half.alias("before"))

    @F.arrow_udf("long")
    def new_tokens(after, before):
        import pyarrow as pa

        from ..functions.tokens import prose_streams

        return pa.array([int(diff.diff_tokens(a.hashes, b.hashes).is_new.sum()) for a, b in zip(prose_streams(after), prose_streams(before), strict=True)], pa.int64())

    return rows.select("doc_id", new_tokens("after", "before").alias("n_new"))


def myers_diff(spark: SparkSession, d: str) -> DataFrame:
    """Edit sizes between the turns of a conversation: tokens, new ones, kept ones."""
    turns = table(spark, d, "conversations")
    rows = turns.select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before")).filter("before is not null")

    @F.arrow_udf("struct<n_tokens:bigint,n_new:bigint,n_kept:bigint,capped:boolean>")
    def sizes(after, before):
        import pyarrow as pa

        from ..functions.tokens import prose_streams

        rows = []
        for a, b in zip(prose_streams(after), prose_streams(before), strict=True):
            found = diff.diff_tokens(a.hashes, b.hashes)
            rows.append({"n_tokens": len(a.hashes), "n_new": int(found.is_new.sum()), "n_kept": int((found.target >= 0).sum()), "capped": found.capped})
        return pa.array(rows, pa.struct([("n_tokens", pa.int64()), ("n_new", pa.int64()), ("n_kept", pa.int64()), ("capped", pa.bool_())]))

    return rows.select("conv_id", "turn", sizes("text", "before").alias("s")).select("conv_id", "turn", "s.*")


def _item_edits(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    return items.select(F.col("item_id").alias("edit_id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("file"), F.lit("txt").alias("format"), F.lit(None).cast("string").alias("before"), F.lit("absent").alias("before_kind"), F.lit(None).cast("string").alias("before_path"), F.col("text").alias("after"))


def greedy_matches(spark: SparkSession, d: str) -> DataFrame:
    """New benchmark items as files: what they duplicate of the documents, after suppression, in order."""
    found = matches.new_duplicates(_item_edits(spark, d), corpus.document_tokens(spark, d), PROBE_TOKENS, 1)
    return found.select("edit_id", "file", "other_file", *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "other_start", "other_end", "tokens", "place")])


def session_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items written twice in eight sessions, one of which is cleared between: what each edit is told anew."""
    once = _item_edits(spark, d).withColumn("session", F.col("edit_id") % 8).withColumn("seq", F.col("edit_id"))
    twice = once.withColumn("edit_id", F.col("edit_id") + 1_000_000).withColumn("seq", F.col("seq") + 1_000_000)
    clears = spark.range(1).select(F.lit(0).cast("long").alias("session"), F.lit(999_999).cast("long").alias("seq"))
    told = warnings.new_matches(once.unionByName(twice), corpus.document_tokens(spark, d), clears, PROBE_TOKENS, 1)
    return told.groupBy("session", "seq", "file", F.col("epoch").cast("long").alias("epoch")).agg(F.count(F.lit(1)).alias("n_told"))


def insert_edit_matches(spark: SparkSession, d: str) -> DataFrame:
    """Edits that add the second half of each document's lines: what they duplicate of other documents or of themselves anew."""
    docs = table(spark, d, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    half = F.array_join(F.slice(lines, F.lit(1), F.ceil(F.size(lines) / 2).cast("int")), "\n")
    edits = docs.select(F.col("doc_id").alias("edit_id"), F.col("doc_id").cast("string").alias("file"), F.lit("txt").alias("format"), half.alias("before"), F.lit("content").alias("before_kind"), F.lit(None).cast("string").alias("before_path"), F.col("text").alias("after"))
    return matches.new_duplicates(edits, corpus.document_files(spark, d), C.MIN_TOKENS, 1, corpus.kept)


def conversation_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits that append a turn and a document to a conversation's file, against the documents."""
    return matches.new_duplicates(corpus.conversation_edits(spark, d), corpus.document_files(spark, d), PROBE_TOKENS, 1, corpus.kept)


def match_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the runs between benchmark items and documents, from the items' tokens."""
    tokens = fingerprints.exploded_tokens(table(spark, d, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("file"), "text"), "file")
    listed = tokens.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]).alias("tokens"))
    own = F.slice("tokens", F.col("region") + 1, F.col("len"))
    return _probe_runs(spark, d).join(listed, "file").select("file", "other_file", F.col("region").cast("long").alias("region"), F.col("len").cast("long").alias("len"), matches.match_key(F.col("file"), F.col("other_file"), own).alias("key"))


def index_upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "lang", "text")
    changed = docs.filter("lang = 'de'").withColumn("text", F.concat(F.lit("v2 "), "text"))
    return maintenance.delete(maintenance.upsert(docs, changed), docs.filter("lang = 'es'")).select("file", F.md5("text").alias("content"))


def rescan_actions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "lang", F.octet_length("text").cast("long").alias("size"), F.lit(0.0).alias("mtime_ms"))
    listing = docs.filter("lang <> 'es'").withColumn("size", F.col("size") + F.when(F.col("lang") == "de", 1).otherwise(0))
    return maintenance.rescan_actions(docs.filter("lang <> 'fr'"), listing)


def file_cap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "lang", F.col("doc_id").alias("listing_ord"))
    return maintenance.within_limit(docs.select("file", "listing_ord"), docs.filter("lang = 'fr'"), 500)


def edit_before_lookup(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.lit("log").alias("file"), F.col("turn").alias("seq"), F.col("text").alias("after"))
    return maintenance.pre_images(turns).select("session", "seq", F.md5("before").alias("before"), "before_kind")


def captured_before(spark: SparkSession, d: str) -> DataFrame:
    """Views as calls, clicks as results: at most four calls of a user are open."""
    events = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "event_type", F.get_json_object("props", "$.k").alias("call_id"), F.lit("f").alias("file"))
    calls = events.filter("event_type = 'view'").withColumn("before", F.col("seq").cast("string"))
    return maintenance.captured_befores(calls, events.filter("event_type = 'click'"), 4).select("session", "seq", "before", "before_kind")


def ledger_first_seen(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("is_clear"), F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("key"))
    return ledger.first_seen(events).select("session", "seq", "key", F.col("epoch").cast("long").alias("epoch"))


def delivery_routing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    way = ledger.delivery(F.col("value") * 20, F.when(F.col("event_type") == "click", "in-band").otherwise("steer"), F.col("event_type") == "view", F.col("event_type") != "error")
    return e.select("event_id", way.alias("delivery"), ledger.triggers_rescan(F.col("event_type")).alias("rescan"))


def report_top4(spark: SparkSession, d: str) -> DataFrame:
    """Reports of the runs between each benchmark item and the documents, longest first."""
    return _reports(spark, d).select("edit_id", "file", F.size("shown").cast("long").alias("shown"), F.col("omitted").cast("long").alias("omitted"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    found = _probe_runs(spark, d)
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.col("len").desc(), "other_file", "region", "other"))
    rows = found.select(F.col("file").alias("edit_id"), "file", (F.col("region") + 1).alias("start_line"), (F.col("region") + F.col("len")).alias("end_line"), "other_file", (F.col("other") + 1).alias("other_start"), (F.col("other") + F.col("len")).alias("other_end"), F.col("len").alias("tokens"), F.lit("k").alias("key"), place.alias("place"), F.lit(None).cast("string").alias("excerpt"))
    return ledger.reports(rows)


def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of each report and what goes to an artifact; places are token numbers here, as items have few lines."""
    return _reports(spark, d).select("edit_id", "text", "artifact_id", "artifact")


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """An excerpt of each document from its second line to its last."""
    lines = F.size(F.split("text", "\n"))
    return table(spark, d, "documents").filter(lines > 1).select("doc_id", ledger.excerpt(F.col("text"), F.lit(2), lines).alias("excerpt"))


LAYERS = [{"minTokens": "50", "ignore": "a/**,b.{ts,tsx}", "ignoreTests": "false"}, {"minTokens": 3, "ignorePatterns": ["b.{ts,tsx}", "c"], "minLines": 7.9}]


def config_merge(spark: SparkSession, d: str) -> DataFrame:
    warnings: list[str] = []
    merged = config.merge_layers([config.read_layer(LAYERS[0], "project", warnings), config.read_layer(LAYERS[1], "settings", warnings, project=False)])
    row = (merged.min_tokens, merged.min_lines, merged.max_indexed_files, merged.ignore_tests, "|".join(merged.ignore_patterns))
    return spark.createDataFrame([row], "min_tokens long, min_lines long, max_files long, ignore_tests boolean, patterns string")


def brace_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = [(p, "|".join(globs.expand_braces(p))) for p in ("src/*.{ts,tsx}", "{a,b{c,d}}/x", "{x}", r"\{a,b}", "a{b,c}{d,e}")]
    return spark.createDataFrame(rows, "pattern string, expanded string")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    format_ = F.when(F.col("lang") != "fr", F.col("lang"))
    reason = F.when(F.octet_length("text") > 5000, "too-large")
    rows = docs.select(format_.alias("format"), reason.alias("skip_reason"), (F.col("text") == "").alias("failed"))
    return maintenance.status(rows.withColumn("indexed", F.col("format").isNotNull() & F.col("skip_reason").isNull() & ~F.col("failed")))


def edit_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits of two files, the second one moved; clicks' first files fail."""
    e = table(spark, d, "events")
    one = F.struct(F.concat(F.lit("a"), "user_id").alias("path"), F.lit(None).cast("string").alias("source_path"), (F.col("event_type") == "click").alias("is_error"))
    two = F.struct(F.concat(F.lit("b"), "user_id").alias("path"), F.concat(F.lit("c"), "user_id").alias("source_path"), F.lit(False).alias("is_error"))
    return maintenance.edit_requests(e.select("event_id", F.array(one, two).alias("results"))).select("event_id", F.col("seq").cast("long").alias("seq"), "file", "before_path")


def tool_paths(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "pages").select(F.col("url").alias("path"))
    more = spark.range(1).select(F.explode(F.array(F.lit("~/a.ts"), F.lit(" "), F.lit("src/x.ts"), F.lit("~b"))).alias("path"))
    return urls.unionByName(more).select("path", paths.tool_path(F.col("path")).alias("resolved"))


QUERIES = {f.__name__: f for f in (
    tokenize_docs, token_hash, line_spans, block_streams, size_filter, generated_filter, path_classify, test_path_flag, format_detect, content_dedupe, kgram_hash, winnow_fingerprints, posting_lists, cross_runs,
    benchmark_contamination, self_runs, self_runs_all, trim_partial_lines, append_edit_new_tokens, myers_diff, greedy_matches, insert_edit_matches, conversation_edits, session_warnings, match_key, index_upsert_delete, rescan_actions, file_cap, edit_before_lookup, captured_before,
    ledger_first_seen, delivery_routing, report_top4, report_text, excerpts, config_merge, brace_expand, status_counts, edit_fan_out, tool_paths,
)}


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}
