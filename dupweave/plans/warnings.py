"""From edits to what sessions are told: check, ledger, excerpts, report and delivery in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import ledger, matches


def new_matches(edits: DataFrame, corpus: DataFrame, clears: DataFrame | None = None, min_tokens: int = C.MIN_TOKENS, min_lines: int = C.MIN_LINES) -> DataFrame:
    """The matches that their session wasn't told of since its last clearing, with session, seq and epoch.

    edits: plans.index.EDIT; corpus: the index's token table; clears: (session, seq).
    """
    found = matches.new_duplicates(edits, corpus, min_tokens, min_lines).join(edits.select("edit_id", "session", "seq"), "edit_id").withColumn("is_clear", F.lit(False))
    if clears is not None:
        found = found.unionByName(clears.select("session", "seq", F.lit(True).alias("is_clear")), allowMissingColumns=True)
    return ledger.first_seen(found)


def session_warnings(edits: DataFrame, corpus: DataFrame, files: DataFrame, clears: DataFrame | None = None, min_tokens: int = C.MIN_TOKENS, min_lines: int = C.MIN_LINES, mode: str = "in-band") -> DataFrame:
    """(session, seq, edit_id, file, text, shown, omitted, artifact_id, artifact, delivery): one row for each edit with something new.

    files: (file, text), where the counterparts' excerpts come from. edits may have latency_ms and is_idle, which delivery
    goes by; a check in a batch is in time and its session at work.
    """
    return reported(new_matches(edits, corpus, clears, min_tokens, min_lines), edits, files, mode)


def reported(told: DataFrame, edits: DataFrame, files: DataFrame, mode: str = "in-band") -> DataFrame:
    """Reports of matches that are to be told, with their sessions and the way they go."""
    texts = files.select(F.col("file").alias("_other"), F.col("text").alias("_text"))
    shown = told.join(texts, F.col("other_file") == F.col("_other"), "left").withColumn("excerpt", ledger.excerpt(F.col("_text"), F.col("other_start"), F.col("other_end"))).drop("_other", "_text")
    given = lambda name, default: F.col(name) if name in edits.columns else F.lit(default)
    way = ledger.delivery(given("latency_ms", 0), F.lit(mode), given("is_idle", False), F.lit(True))
    sessions = edits.select("edit_id", "session", "seq", way.alias("delivery"))
    return ledger.reports(shown).join(sessions, "edit_id")
