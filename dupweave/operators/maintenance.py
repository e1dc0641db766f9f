"""Upkeep of an index as tables: upserts, deletions, rescans, limits, content reuse, status."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C


def upsert(rows: DataFrame, changed: DataFrame, key: str = "file") -> DataFrame:
    """`rows` with those of changed files replaced; a file may have any number of rows, postings too."""
    return rows.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def delete(rows: DataFrame, gone: DataFrame, key: str = "file") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def content_key(format_: Column, text: Column) -> Column:
    return F.concat_ws(":", format_, F.md5(text))


def distinct_contents(files: DataFrame) -> DataFrame:
    """(content_key, format, text): each content once, to be tokenized once; text isn't compared, its digest is."""
    return files.withColumn("content_key", content_key(F.col("format"), F.col("text"))).groupBy("content_key").agg(F.first("format").alias("format"), F.first("text").alias("text"))


def rescan_actions(manifest: DataFrame, listing: DataFrame, start_rev: int | None = None) -> DataFrame:
    """(file, action) for all files of either side: new, changed, same or gone; files written since `start_rev` stay `same`.

    Both have file, size, mtime_ms; the manifest may have rev. A path listed twice counts once.
    """
    seen = listing.groupBy("file").agg(F.first("size").alias("new_size"), F.first("mtime_ms").alias("new_mtime"))
    known = manifest.select("file", "size", "mtime_ms", (F.col("rev") if "rev" in manifest.columns else F.lit(0)).alias("rev"))
    joined = known.withColumn("old", F.lit(True)).join(seen.withColumn("new", F.lit(True)), "file", "full_outer")
    newer = (F.col("rev") > start_rev) if start_rev is not None else F.lit(False)
    action = (
        F.when(F.col("old").isNull(), "new")
        .when(newer, "same")
        .when(F.col("new").isNull(), "gone")
        .when(F.col("size").eqNullSafe(F.col("new_size")) & F.col("mtime_ms").eqNullSafe(F.col("new_mtime")), "same")
        .otherwise("changed")
    )
    return joined.select("file", action.alias("action"))


def within_limit(listing: DataFrame, existing: DataFrame, most: int = C.MAX_INDEXED_FILES) -> DataFrame:
    """(file, indexed): files indexed already always, new ones in listing order as far as `most` allows.

    Only the first `most` new files are ranked; the others can't be admitted whatever their place.
    """
    known = existing.select("file").distinct().withColumn("known", F.lit(True))
    marked = listing.join(known, "file", "left")
    room = existing.select("file").distinct().agg(F.greatest(F.lit(0), F.lit(most) - F.count(F.lit(1))).alias("room"))
    first = marked.filter("known is null").select("file", "listing_ord").orderBy("listing_ord", "file").limit(most)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy("listing_ord", "file")))
    admitted = ranked.filter(F.col("place") <= room.scalar()).select("file", F.lit(True).alias("admitted"))
    return marked.join(admitted, "file", "left").select("file", F.coalesce("known", "admitted", F.lit(False)).alias("indexed"))


def status(verdicts: DataFrame) -> DataFrame:
    """One row of counters over (format, skip_reason, failed, indexed)."""
    count = lambda c: F.count(F.when(c, 1))
    accepted = F.col("format").isNotNull()
    return verdicts.agg(count(F.col("indexed")).alias("indexed_files"), count(accepted).alias("candidate_files"), count(F.col("failed")).alias("failed_files"), F.coalesce(F.max(accepted & F.col("skip_reason").isNull() & ~F.col("failed") & ~F.col("indexed")), F.lit(False)).alias("capped"))


def pre_images(edits: DataFrame) -> DataFrame:
    """Edits of one session with the text before each: the session's latest earlier text of the same file."""
    back = Window.partitionBy("session", "file").orderBy("seq")
    return edits.withColumn("before", F.lag("after").over(back)).withColumn("before_kind", F.when(F.row_number().over(back) == 1, "absent").otherwise("content"))


def captured_befores(calls: DataFrame, results: DataFrame, most: int = C.MAX_PENDING_BEFORES) -> DataFrame:
    """Results with the pre-image captured at the open call of the same id, if its path is the same.

    calls: (session, seq, call_id, file, before); results: (session, seq, call_id, file, ...), one for each seq of a session.
    A call is open until a result of its id comes, or until `most` are open and another call pushes out the oldest.
    Sessions are read in order of seq, row by row: a task holds the open calls of one session, never a session.
    """
    key = [F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("call_id").cast("string"), F.lit("")).alias("call_id"), F.col("file").cast("string").alias("file")]
    both = calls.select(*key, F.col("before").cast("string").alias("before"), F.lit(False).alias("ends")).unionByName(results.select(*key, F.lit(None).cast("string").alias("before"), F.lit(True).alias("ends")))
    schema = "held_session string, held_seq long, before string, before_kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, held = None, {}
        for batch in batches:
            out = []
            for own, seq, call_id, file, before, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != session:
                    session, held = own, {}
                if not ends:
                    if len(held) >= most:
                        del held[next(iter(held))]
                    held[call_id] = file, before
                else:
                    path, text = held.pop(call_id, (None, None))
                    known = path is not None and path == file
                    out.append((own, seq, text if known else None, "unknown" if not known else "absent" if text is None else "content"))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["held_session", "held_seq", "before", "before_kind"])

    answered = both.repartition("session").sortWithinPartitions("session", "seq", "ends").mapInArrow(run, schema)
    same = F.col("session").cast("string").eqNullSafe(F.col("held_session")) & (F.col("seq") == F.col("held_seq"))
    return results.join(answered, same, "left").drop("held_session", "held_seq")


def mutation_requests(results: DataFrame) -> DataFrame:
    """Check requests of tool results, in order: (session, seq, at, file, before, before_kind, before_path).

    results: (session, seq, tool, is_error, resolved_path, edits: array of struct(path, source_path, is_error), before,
    before_kind, captured_path). A write gives its resolved path, with the captured pre-image if that is the same path's; an edit
    gives its files as edit_requests(); anything else, and what failed, gives none: a rescan picks it up.
    """
    fine = results.filter(~F.coalesce("is_error", F.lit(False)))
    own = F.col("captured_path").eqNullSafe(F.col("resolved_path"))
    none = F.lit(None).cast("string")
    writes = fine.filter((F.col("tool") == "write") & (F.coalesce("resolved_path", F.lit("")) != ""))
    writes = writes.select("session", "seq", F.lit(0).alias("at"), F.col("resolved_path").alias("file"), F.when(own, F.col("before")).alias("before"), F.when(own, F.col("before_kind")).otherwise("unknown").alias("before_kind"), none.alias("before_path"))
    edited = edit_requests(fine.filter("tool = 'edit'").select(F.struct("session", "seq").alias("event_id"), F.col("edits").alias("results")))
    edited = edited.select("event_id.session", "event_id.seq", F.col("seq").alias("at"), "file", none.alias("before"), F.lit("unknown").alias("before_kind"), "before_path")
    return writes.unionByName(edited)


def edit_requests(events: DataFrame) -> DataFrame:
    """Check requests of multi-file edits: one for each file without an error; a move gives its target, then its source.

    events: (event_id, results: array of struct(path, source_path, is_error)).
    """
    each = events.select("event_id", F.posexplode("results").alias("at", "r")).filter(~F.coalesce(F.col("r.is_error"), F.lit(False)))
    moved = F.col("r.source_path").isNotNull() & (F.col("r.source_path") != F.col("r.path"))
    target = each.select("event_id", (F.col("at") * 2).alias("seq"), F.col("r.path").alias("file"), F.when(moved, F.col("r.source_path")).alias("before_path"))
    source = each.filter(moved).select("event_id", (F.col("at") * 2 + 1).alias("seq"), F.col("r.source_path").alias("file"), F.lit(None).cast("string").alias("before_path"))
    return target.unionByName(source)
