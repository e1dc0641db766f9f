"""A work tree under watch: index it, rescan what changed, switch it on and off, say how it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, maintenance
from ..sources import repo
from ..sources.config import resolve_options, stable_json
from .index import DuplicateIndex, drop_folder

MANIFEST = "file string, size long, mtime_ms double, rev long, format string, skip_reason string, indexed boolean"
_open: dict[tuple[str, str], Workspace] = {}


class Workspace:
    """The index and the manifest of one root with one set of options; a context manager."""

    def __init__(self, spark: SparkSession, root: str, folder: str, settings: dict | None = None, cwd: str | None = None):
        self.spark, self.root, self.folder = spark, root, folder
        self.options, self.config_path, self.warnings = resolve_options(cwd or root, root, settings)
        self.index = DuplicateIndex(spark, self.options, f"{folder}/index")
        self.manifest = spark.createDataFrame([], MANIFEST)
        self.rev = self.version = 0
        self.state = "indexing"

    def __enter__(self) -> Workspace:
        self.refresh()
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def refresh(self) -> None:
        """Bring the index up to the work tree: only new and changed files are opened and tokenized, gone ones leave.

        Files that the last look rejected, or that are too large, aren't opened either while size and time stay the same.
        """
        self._alive()
        self.rev += 1
        judged = self.index.path_verdicts(repo.listed_files(self.spark, self.root))
        listing = repo.scan(judged, self.root, self.manifest).persist()
        try:
            known = self.manifest.filter("indexed").select("file")
            capped = maintenance.within_limit(listing.filter("skip_reason is null").select("file", "listing_ord"), known, self.options.max_indexed_files)
            wanted = listing.join(capped, "file", "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))
            self._write_manifest(wanted.select("file", "size", "mtime_ms", F.lit(self.rev).cast("long").alias("rev"), "format", "skip_reason", "indexed"))
            fresh = wanted.filter("indexed AND NOT same").select("file", "format", "text")
            gone = self.index.tokens.select("file").join(wanted.filter("indexed").select("file"), "file", "left_anti")
            self.index.change(fresh, gone)
            self.state = "ready"
        finally:
            listing.unpersist()

    def _write_manifest(self, rows: DataFrame) -> None:
        self.version += 1
        path = f"{self.folder}/manifest/r{self.version}"
        rows.write.mode("overwrite").parquet(path)
        self.manifest = self.spark.read.schema(MANIFEST).parquet(path)
        drop_folder(self.spark, f"{self.folder}/manifest/r{self.version - 2}")

    def _alive(self) -> None:
        if self.state == "unavailable":
            raise RuntimeError("this workspace was released")

    def status(self) -> dict:
        """State, counters and a sentence."""
        rows = self.manifest.withColumn("failed", F.lit(False))
        row = maintenance.status(rows).withColumn("state", F.lit(self.state))
        told = row.withColumn("sentence", ledger.status_sentence(F.col("state"), F.col("indexed_files"), F.col("candidate_files"), F.col("failed_files"), F.col("capped")))
        return told.first().asDict() | {"root": self.root, "options": stable_json(vars(self.options))}

    def check(self, edits: DataFrame, store: bool = True) -> DataFrame:
        """What edits duplicate anew; edits of files that wouldn't be indexed are left out.

        The index then holds the files as edited, marked with an unknown size and time, so that the next refresh reads them.
        Files that aren't indexed yet are taken in as far as the limit allows.
        """
        self._alive()
        judged = self.index.verdicts(edits.drop("format").withColumn("text", F.col("after")))
        accepted = judged.filter("skip_reason is null").drop("skip_reason")
        found = self.index.check(accepted.drop("text")).checkpoint()
        if store:
            last = accepted.groupBy("file").agg(F.max_by(F.struct("format", "text"), F.struct("seq", "edit_id")).alias("last")).select("file", "last.*")
            known = self.manifest.filter("indexed").select("file")
            capped = maintenance.within_limit(last.select("file", F.lit(0).cast("long").alias("listing_ord")), known, self.options.max_indexed_files)
            taken = last.join(capped.filter("indexed").select("file"), "file", "left_semi")
            none = self.index.tokens.select("file").limit(0)
            self.index.change(taken, none)
            marked = taken.select("file", F.lit(-1).cast("long").alias("size"), F.lit(None).cast("double").alias("mtime_ms"), F.lit(self.rev).cast("long").alias("rev"), "format", F.lit(None).cast("string").alias("skip_reason"), F.lit(True).alias("indexed"))
            self._write_manifest(maintenance.upsert(self.manifest, marked).select(*self.manifest.columns))
        return found

    def release(self) -> None:
        self.state = "unavailable"
        for key in [k for k, w in _open.items() if w is self]:
            del _open[key]


def acquire(spark: SparkSession, cwd: str, folder: str, settings: dict | None = None) -> Workspace | None:
    """The workspace of the work tree that holds `cwd`: a shared one for the same root and options; None outside one."""
    root = repo.repo_root(cwd)
    if root is None:
        return None
    key = root, stable_json(vars(resolve_options(cwd, root, settings)[0]))
    if key not in _open:
        workspace = Workspace(spark, root, folder, settings, cwd)
        workspace.refresh()
        _open[key] = workspace
    return _open[key]


def restart(workspace: Workspace, settings: dict | None = None) -> Workspace | None:
    """Release a workspace and acquire its root again, with options read anew."""
    workspace.release()
    return acquire(workspace.spark, workspace.root, workspace.folder, settings)


def service_stats() -> dict[str, int]:
    """How many workspaces are open, and how many of them are ready."""
    return {"workspaces": len(_open), "ready": sum(w.state == "ready" for w in _open.values())}


def command(argument: str, state_path: str, cwd: str, workspace: Workspace | None = None) -> str:
    """on, off or status for the project that holds `cwd`; what was done or how it stands."""
    action = argument.strip().lower()
    if action in ("on", "off"):
        repo.set_project_enabled(state_path, cwd, action == "on")
        if action == "off" and workspace:
            workspace.release()
        return f"Duplicate detection is {action} for this project."
    if action in ("", "status"):
        enabled = "on" if repo.is_project_enabled(state_path, cwd) else "off"
        detail = f"{workspace.status()['sentence']}; root {workspace.root}; reminders: {workspace.options.reminder_mode}" if workspace else "not running"
        return f"Duplicate detection is {enabled} for this project ({detail})."
    return f"{argument.strip()!r} isn't on, off or status."
