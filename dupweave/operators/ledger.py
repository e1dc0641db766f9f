"""What a session is told: each match once, by which way, and in what words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C

# The words of reports are this package's own.
ADVICE = "Call or import the existing code, or move what both share into one helper. Leave it if the copy is meant."


def first_seen(warnings: DataFrame) -> DataFrame:
    """Rows (session, seq, is_clear, key) that report a key not reported before in the session since its last clearing."""
    running = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    epochs = warnings.withColumn("epoch", F.sum(F.col("is_clear").cast("int")).over(running)).filter(~F.col("is_clear"))
    order = ["seq", *(c for c in ("edit_id", "place") if c in warnings.columns)]
    first = F.row_number().over(Window.partitionBy("session", "epoch", "key").orderBy(*order))
    return epochs.withColumn("_first", first).filter("_first = 1").drop("_first", "is_clear")


def delivery(latency_ms: Column, mode: Column, is_idle: Column, current: Column) -> Column:
    """How a result reaches the session: dropped if the session moved on; within the budget with the tool's result."""
    late = latency_ms > C.CHECK_BUDGET_MS
    return F.when(~current, "dropped").when(~late & (mode == "in-band"), "in-band").when(is_idle, "next-turn").otherwise("aside")


def triggers_rescan(event: Column) -> Column:
    return ~event.isin(C.READ_ONLY_EVENTS)


def describe(m: Column) -> Column:
    """`m`: struct(file, start_line, end_line, other_file, other_start, other_end, excerpt)."""
    return F.format_string("%s, lines %d to %d: as in %s, lines %d to %d (%d lines)", m["file"], m["start_line"], m["end_line"], m["other_file"], m["other_start"], m["other_end"], m["end_line"] - m["start_line"] + 1)


def region_label(file: Column, start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat_ws(":", file, start.cast("string"))).otherwise(F.format_string("%s:%d-%d", file, start, end))


def match_facts(lines: Column, tokens: Column) -> Column:
    return F.concat(F.format_string("%d %s", lines, F.when(lines == 1, "line").otherwise("lines")), F.lit(" · "), F.format_string("%d %s", tokens, F.when(tokens == 1, "token").otherwise("tokens")))


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """The counterpart's first lines, long ones cut, with the number of lines left out; null without text or for large files."""
    most = F.least(F.lit(C.SNIPPET_LINES), end - start + 1)
    lines = F.slice(F.split(text, r"\r?\n"), start, most)
    cut = F.transform(lines, lambda line: F.when(F.length(line) > C.SNIPPET_LINE_CHARS, F.concat(F.substring(line, 1, C.SNIPPET_LINE_CHARS), F.lit("…"))).otherwise(line))
    left = end - start + 1 - C.SNIPPET_LINES
    body = F.array_join(F.when(left > 0, F.concat(cut, F.array(F.format_string("… (%d more lines)", left)))).otherwise(cut), "\n")
    return F.when((F.octet_length(text) <= C.SNIPPET_MAX_FILE_BYTES) & (F.size(lines) > 0), body)


def fenced(body: Column) -> Column:
    fence = F.when(F.contains(body, F.lit("```")), "~~~~").otherwise("```")
    return F.concat_ws("\n", fence, body, fence)


def _entry(m: Column, with_excerpt: bool) -> Column:
    head = F.concat(F.lit("- "), describe(m))
    if not with_excerpt:
        return head
    return F.when(m["excerpt"].isNull(), head).otherwise(F.concat_ws("\n", head, F.concat(F.lit("  It reads, in "), m["other_file"], F.lit(":")), fenced(m["excerpt"])))


def _composed(file: Column, matches: Column, omitted: Column, artifact: Column, with_excerpts: bool) -> Column:
    entries = F.transform(matches, lambda m: _entry(m, with_excerpts))
    more = F.when((omitted > 0) & artifact.isNotNull(), F.format_string("(%d more not shown; all of them: artifact://%s)", omitted, artifact))
    more = more.when(omitted > 0, F.format_string("(%d more not shown)", omitted)).when(artifact.isNotNull(), F.concat(F.lit("All with their code: artifact://"), artifact))
    return F.concat_ws("\n", F.concat(F.lit("What was just written to "), file, F.lit(" is there already:")), entries, more, F.lit(ADVICE))


def reports(matches: DataFrame) -> DataFrame:
    """(edit_id, file, text, shown, omitted, artifact_id, artifact) from match rows with `place` and `excerpt`.

    At most MAX_INLINE_MATCHES are shown. Above that, or above MAX_INLINE_BYTES, the whole report goes to the
    artifact column, to be written as a text file by the caller; a report still too long leaves out the excerpts.
    """
    m = F.struct("place", "file", "start_line", "end_line", "other_file", "other_start", "other_end", "tokens", "key", "excerpt")
    listed = matches.groupBy("edit_id", "file").agg(F.array_sort(F.collect_list(m)).alias("matches"))
    shown, none = F.slice("matches", 1, C.MAX_INLINE_MATCHES), F.lit(None).cast("string")
    omitted = F.greatest(F.size("matches") - C.MAX_INLINE_MATCHES, F.lit(0))
    rows = listed.withColumn("shown", shown).withColumn("omitted", omitted)
    rows = rows.withColumn("inline", _composed(F.col("file"), F.col("shown"), F.col("omitted"), none, True))
    large = (F.col("omitted") > 0) | (F.octet_length("inline") > C.MAX_INLINE_BYTES)
    rows = rows.withColumn("artifact", F.when(large, _composed(F.col("file"), F.col("matches"), F.lit(0), none, True)))
    rows = rows.withColumn("artifact_id", F.when(large, F.substring(F.sha2(F.col("artifact").cast("binary"), 256), 1, 16)))
    full = _composed(F.col("file"), F.col("shown"), F.col("omitted"), F.col("artifact_id"), True)
    short = _composed(F.col("file"), F.col("shown"), F.col("omitted"), F.col("artifact_id"), False)
    text = F.when(~large, F.col("inline")).when(F.octet_length(full) > C.MAX_INLINE_BYTES, short).otherwise(full)
    return rows.select("edit_id", "file", text.alias("text"), "shown", "omitted", "artifact_id", "artifact")


def content_text(parts: Column) -> Column:
    """Text parts joined, without the wrapper tags around them."""
    return F.regexp_replace(F.array_join(parts, "\n"), r"^\s*<[a-z-]+>\n?|\n?</[a-z-]+>\s*$", "")


def status_sentence(state: Column, indexed: Column, candidates: Column, failed: Column, capped: Column) -> Column:
    ready = F.concat(F.format_string("%d of %d files indexed", indexed, candidates), F.when(failed > 0, F.format_string(", %d failed", failed)).otherwise(""), F.when(capped, " (limit reached)").otherwise(""))
    return F.when(state == "ready", ready).when(state == "indexing", F.concat(F.lit("indexing: "), ready)).otherwise(state)


def valid_details(json: Column) -> Column:
    """Whether a stored warning has the shape of one: file, root, matches with both regions, omitted."""
    region = "struct<file:string,startLine:int,endLine:int>"
    d = F.from_json(json, f"struct<file:string,root:string,omitted:int,matches:array<struct<key:string,tokens:int,region:{region},other:{region}>>>")
    whole = lambda r: r["file"].isNotNull() & (r["startLine"] >= 1) & (r["endLine"] >= r["startLine"])
    return F.coalesce(d["file"].isNotNull() & d["root"].isNotNull() & (d["omitted"] >= 0) & F.forall(d["matches"], lambda m: m["key"].isNotNull() & (m["tokens"] > 0) & whole(m["region"]) & whole(m["other"])), F.lit(False))
