"""Files of a repository as DataFrames, and per-project switches kept in a small JSON file."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import stat as statmod
import subprocess
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import constants as C
from ..functions.paths import path_verdict, skip_reason


def _git(cwd: str, *args: str, timeout: float = 10) -> str | None:
    env = {k: v for k, v in os.environ.items() if k not in C.GIT_REDIRECTS} | {"GIT_OPTIONAL_LOCKS": "0"}
    try:
        done = subprocess.run(["git", *args], cwd=cwd, env=env, capture_output=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode(errors="replace") if done.returncode == 0 else None


def repo_root(cwd: str) -> str | None:
    """The work tree that holds `cwd`, through links; None outside one."""
    real = os.path.realpath(cwd)
    found = _git(real, "rev-parse", "--show-toplevel") if os.path.isdir(real) else None
    return os.path.realpath(found.strip()) if found and found.strip() else None


def relative_path(root: str, path: str) -> str | None:
    """`path` from the root with slashes, both through links; None outside."""
    name = os.path.relpath(os.path.realpath(path), os.path.realpath(root)).replace(os.sep, "/")
    return None if name == ".." or name.startswith("../") else name


LISTING_ROWS, READ_BYTES = 5000, 16 << 20


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, listing_ord): tracked and untracked files that git doesn't ignore; a path listed twice counts once.

    One task reads git's output in pieces, so a listing of any length is never held as a whole.
    """
    args = ["git", "ls-files", "-z", "--cached", "--others", "--exclude-standard", *(f"--exclude={d}/" for d in C.IGNORED_DIRS)]
    env = {k: v for k, v in os.environ.items() if k not in C.GIT_REDIRECTS} | {"GIT_OPTIONAL_LOCKS": "0"}

    def rows(names: list[str], first: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(range(first, first + len(names)), pa.int64())], names=["file", "listing_ord"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            with subprocess.Popen(args, cwd=root, env=env, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as git:
                names, pending, last, n = [], b"", None, 0
                while True:
                    chunk = git.stdout.read(1 << 18)
                    *whole, pending = (pending + chunk + (b"" if chunk else b"\0")).split(b"\0")
                    for name in whole:
                        # Git lists tracked files in order: a path with several stages comes in a row.
                        if name and name != last:
                            names.append(name.decode(errors="surrogateescape").encode("utf-8", "replace").decode())
                        last = name
                    if len(names) >= LISTING_ROWS or not chunk:
                        yield rows(names, n)
                        n, names = n + len(names), []
                    if not chunk:
                        break
            if git.returncode:
                raise RuntimeError(f"git ls-files failed in {root}: exit code {git.returncode}")

    return spark.range(0, 1, 1, 1).mapInArrow(run, "file string, listing_ord long")


def _with(files: DataFrame, fields: list[tuple[str, pa.DataType, str]], values) -> DataFrame:
    """`files` with more columns, made by `values` from pieces of batches: it yields (rows, values by field) in order."""
    schema = StructType([*files.schema.fields, *StructType.fromDDL(", ".join(f"{name} {ddl}" for name, _, ddl in fields)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n, columns in values(batch):
                made = [pa.array(c, kind) for c, (_, kind, _) in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns, *made], names=[*batch.schema.names, *(name for name, _, _ in fields)])
                at += n

    return files.mapInArrow(run, schema)


def stat_files(files: DataFrame, root: str, wanted: str = "wanted") -> DataFrame:
    """`files` (file, ...) with size and mtime_ms of the wanted ones; null where there is no such file (any more)."""

    def stat(name: str) -> tuple[int | None, float | None]:
        try:
            found = os.stat(os.path.join(root, name))
        except (OSError, ValueError):
            return None, None
        return (found.st_size, found.st_mtime_ns / 1e6) if statmod.S_ISREG(found.st_mode) else (None, None)

    def values(batch: pa.RecordBatch):
        names, asked = batch.column("file").to_pylist(), batch.column(wanted).to_pylist()
        found = [stat(n) if w else (None, None) for n, w in zip(names, asked, strict=True)]
        yield batch.num_rows, list(zip(*found, strict=True)) or [[], []]

    return _with(files, [("size", pa.int64(), "long"), ("mtime_ms", pa.float64(), "double")], values)


def read_texts(files: DataFrame, root: str, most_bytes: int = C.MAX_FILE_BYTES, wanted: str = "wanted") -> DataFrame:
    """`files` (file, ...) with text and read_error (deleted, too-large or failed) of the wanted ones. No other file is opened.

    A file that has grown since it was looked at is read no further than `most_bytes`; rows leave in pieces of bounded size.
    """

    def read(name: str) -> tuple[str | None, str | None]:
        try:
            with open(os.path.join(root, name), "rb") as f:
                data = f.read(most_bytes + 1)
        except FileNotFoundError:
            return None, "deleted"
        except (OSError, ValueError):
            return None, "failed"
        return (None, "too-large") if len(data) > most_bytes else (data.decode(errors="replace"), None)

    def values(batch: pa.RecordBatch):
        texts, errors, held = [], [], 0
        for name, asked in zip(batch.column("file").to_pylist(), batch.column(wanted).to_pylist(), strict=True):
            text, error = read(name) if asked else (None, None)
            texts.append(text)
            errors.append(error)
            held += len(text or "")
            if held > READ_BYTES:
                yield len(texts), [texts, errors]
                texts, errors, held = [], [], 0
        yield len(texts), [texts, errors]

    return _with(files, [("text", pa.string(), "string"), ("read_error", pa.string(), "string")], values)


def scan(judged: DataFrame, root: str, known: DataFrame | None = None, most_bytes: int = C.MAX_FILE_BYTES) -> DataFrame:
    """judged (file, listing_ord, format, reason) -> with size, mtime_ms, text, skip_reason and same.

    Paths with a reason aren't looked at. Files with the size and time that `known` (file, size, mtime_ms, skip_reason,
    indexed) has, indexed or rejected then, are `same`: they keep their reason and aren't opened, nor are files above
    `most_bytes`.
    """
    looked = stat_files(judged.repartition("file").withColumn("wanted", F.col("reason").isNull()), root).drop("wanted")
    if known is None:
        looked = looked.withColumn("same", F.lit(False)).withColumn("known_reason", F.lit(None).cast("string"))
    else:
        settled = known.filter("indexed OR skip_reason IS NOT NULL").select(F.col("file").alias("known_file"), F.col("size").alias("known_size"), F.col("mtime_ms").alias("known_mtime"), F.col("skip_reason").alias("known_reason"))
        looked = looked.join(settled, F.col("file") == F.col("known_file"), "left")
        same = F.col("size").isNotNull() & (F.col("size") == F.col("known_size")) & (F.col("mtime_ms") == F.col("known_mtime"))
        looked = looked.withColumn("same", F.coalesce(same, F.lit(False))).drop("known_file", "known_size", "known_mtime")
    early = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("size").isNull(), "deleted").when(F.col("size") > most_bytes, "too-large")
    read = read_texts(looked.withColumn("early", early).withColumn("wanted", F.col("early").isNull() & ~F.col("same")), root, most_bytes)
    reason = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("same"), F.col("known_reason")).when(F.col("read_error").isNotNull(), F.col("read_error")).otherwise(skip_reason(F.col("text"), most_bytes))
    return read.withColumn("skip_reason", reason).select("file", "format", F.coalesce("size", F.lit(-1)).alias("size"), "mtime_ms", "listing_ord", F.when(F.col("skip_reason").isNull(), F.col("text")).alias("text"), "skip_reason", "same")


def read_files(spark: SparkSession, root: str, most_bytes: int = C.MAX_FILE_BYTES, known: DataFrame | None = None) -> DataFrame:
    """(file, format, size, mtime_ms, listing_ord, text, skip_reason, same) of a work tree, by the default options."""
    judged = listed_files(spark, root).withColumn("v", path_verdict(F.col("file"))).select("file", "listing_ord", "v.*")
    return scan(judged, os.path.realpath(root), known, most_bytes)


def read_before(path: str, most_bytes: int = C.MAX_BEFORE_BYTES) -> tuple[str, str | None]:
    """(before_kind, text) of a file about to change: absent if there is none, unknown if it can't be had."""
    try:
        if not os.path.isfile(path):
            return ("unknown", None) if os.path.exists(path) else ("absent", None)
        if os.path.getsize(path) > most_bytes:
            return "unknown", None
        with open(path, encoding="utf-8", errors="replace") as f:
            return "content", f.read()
    except FileNotFoundError:
        return "absent", None
    except OSError:
        return "unknown", None


def project_key(cwd: str) -> str:
    """One key for a repository and all its work trees and copies that borrow its objects; the folder outside git."""
    common = _git(cwd, "rev-parse", "--path-format=absolute", "--git-common-dir", timeout=5)
    if not common:
        return os.path.realpath(cwd)
    common = os.path.realpath(common.strip())
    try:
        with open(os.path.join(common, "objects", "info", "alternates"), encoding="utf-8") as f:
            borrowed = f.readline().strip()
        if borrowed and os.path.basename(borrowed) == "objects":
            return os.path.realpath(os.path.dirname(borrowed))
    except OSError:
        pass
    return common


def short_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def load_state(path: str) -> tuple[dict[str, dict], str | None]:
    """(projects, what is wrong). Entries without a boolean switch are left out; a broken file is an empty state."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        projects = raw["projects"] if raw.get("version") == 1 else None
        return {k: e for k, e in projects.items() if isinstance(e, dict) and isinstance(e.get("enabled"), bool)}, None
    except FileNotFoundError:
        return {}, None
    except (OSError, ValueError, AttributeError, KeyError, TypeError) as e:
        return {}, f"{path}: {e}"


def set_project_enabled(path: str, cwd: str, enabled: bool) -> None:
    """Set one project's switch. The file is replaced as a whole; a broken one is kept beside it; an old key moves."""
    projects, wrong = load_state(path)
    if wrong:
        os.replace(path, f"{path}.broken-{int(time.time())}")
    key, old = project_key(cwd), os.path.realpath(cwd)
    if old != key:
        projects.pop(old, None)
    projects[key] = {"enabled": enabled, "updatedAt": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "displayPath": old}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.{os.getpid()}.new", "w", encoding="utf-8") as f:
        json.dump({"version": 1, "projects": projects}, f, indent=2)
    os.replace(f.name, path)


def is_project_enabled(path: str, cwd: str) -> bool:
    projects, _ = load_state(path)
    entry = projects.get(project_key(cwd)) or projects.get(os.path.realpath(cwd))
    return entry["enabled"] if entry else True


# Names of token caches that older versions left behind, files and folders.
STALE_FILE, STALE_FOLDER = r"\.(sqlite|sqlite-wal|sqlite-shm)$", r"^[0-9a-f]{16}_[0-9a-f]{16}$"


def remove_stale_caches(folder: str) -> list[str]:
    """Remove old token caches from a cache folder and name them; nothing else is touched, errors are passed over."""
    gone = []
    try:
        entries = list(os.scandir(folder))
    except OSError:
        return gone
    for e in entries:
        is_folder = e.is_dir(follow_symlinks=False)
        if re.search(STALE_FOLDER if is_folder else STALE_FILE, e.name) and (is_folder or e.is_file(follow_symlinks=False)):
            shutil.rmtree(e.path, ignore_errors=True) if is_folder else os.unlink(e.path)
            gone.append(e.name)
    return sorted(gone)
