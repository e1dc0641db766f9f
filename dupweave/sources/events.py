"""Events of agent sessions, from JSON lines: calls, results, clearings and rescans, and the edits that come of them.

A source is a folder of JSON lines with the fields of EVENTS; what else a line has is left out. The readers give the same
columns for batches and streams, so everything here but the captured pre-images, which need a session's order, works on both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import tool_path
from ..operators import ledger, maintenance
from .repo import read_before, read_texts

EDITS = "array<struct<path:string,source_path:string,is_error:boolean>>"
EVENTS = f"session string, seq long, name string, call_id string, tool string, path string, resolved_path string, is_error boolean, latency_ms long, is_idle boolean, edits {EDITS}"

# Events that begin a session anew, and so clear what it was told.
CLEARS = ["session_start", "session_switch", "session_branch", "session_tree", "session_shutdown"]


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(folder)


def read_event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(folder)


def clears(events: DataFrame) -> DataFrame:
    """(session, seq) at which what a session was told is forgotten."""
    return events.filter(F.col("name").isin(CLEARS)).select("session", "seq")


def rescans(events: DataFrame) -> DataFrame:
    """(session, seq) at which files may have changed in a way that isn't reported file by file."""
    reported = F.col("tool").isin("write", "edit") & ~F.coalesce("is_error", F.lit(False)) & ((F.col("tool") == "edit") | (F.coalesce("resolved_path", F.lit("")) != ""))
    changed = (F.col("name") == "tool_result") & ledger.triggers_rescan(F.col("tool")) & ~reported
    return events.filter(changed | (F.col("name") == "before_agent_start")).select("session", "seq")


def captured_calls(events: DataFrame, home: str = "/home/user") -> DataFrame:
    """(session, seq, call_id, file, before, kind) of write calls: their file as it is when this runs, before the tool does."""
    calls = events.filter((F.col("name") == "tool_call") & (F.col("tool") == "write")).select("session", "seq", "call_id", tool_path(F.col("path"), home).alias("file")).filter("file IS NOT NULL")

    @F.udf("struct<kind:string,before:string>")
    def captured(path):
        return read_before(path)

    return calls.withColumn("c", captured("file")).select("session", "seq", "call_id", "file", "c.before", "c.kind")


def requests(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Check requests (maintenance.mutation_requests) of the results among `events`; calls: captured_calls()."""
    results = events.filter("name = 'tool_result'").withColumn("file", F.when(F.col("tool") == "write", F.col("resolved_path")).otherwise(F.col("path")))
    known = calls.filter("kind <> 'unknown'") if "kind" in calls.columns else calls
    held = maintenance.captured_befores(known, results)
    return maintenance.mutation_requests(held.withColumn("captured_path", F.when(F.col("before_kind") != "unknown", F.col("resolved_path"))))


def edits_of(requested: DataFrame, root: str) -> DataFrame:
    """Requests as edits (plans.index.EDIT but for the format): each file's text as it is now in the work tree; gone files have none."""
    base = root.rstrip("/") + "/"
    inside = requested.filter(F.col("file").startswith(base) | ~F.col("file").startswith("/"))
    local = lambda c: F.when(F.col(c).startswith(base), F.substring(F.col(c), len(base) + 1, 100_000)).otherwise(F.col(c))
    named = inside.withColumn("file", local("file")).withColumn("before_path", local("before_path")).withColumn("wanted", F.lit(True))
    read = read_texts(named, root)
    number = F.xxhash64("session", "seq", "at", "file").alias("edit_id")
    return read.select(number, "session", (F.col("seq") * 1000 + F.col("at")).alias("seq"), "file", "before", "before_kind", "before_path", F.col("text").alias("after"))
