"""Winnowed fingerprints of token streams: an array kernel for scale, and the same selection as SQL windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.tokens import Stream, run_hashes, streams

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_and_window(min_tokens: int = C.MIN_TOKENS) -> tuple[int, int]:
    """Gram length k and window w with k + w - 1 = min_tokens, so every run of min_tokens holds a fingerprint."""
    k = max(1, math.ceil(min_tokens / 2))
    return k, min_tokens - k + 1


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k tokens from each place; NONE where a separator is among them."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    out = run_hashes(tokens.view(np.uint64), at, at + k)
    out[out == NONE] = NONE - np.uint64(1)
    stops = np.concatenate(([0], np.cumsum(tokens == C.SEPARATOR)))
    out[stops[k:] > stops[:-k]] = NONE
    return out


def winnow(tokens: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, positions): the rightmost least gram of each window of w grams, each place once."""
    grams = gram_hashes(tokens, k)
    if len(grams) < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams[::-1], w)
    at = np.unique(len(grams) - 1 - (windows.argmin(axis=1) + np.arange(len(windows))))
    at = at[grams[at] != NONE]
    return grams[at], at


def token_table(files: DataFrame) -> DataFrame:
    """(file, format, text) -> (file, hashes, start_lines, end_lines); other formats than code's are prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names = [], batch.column(0).to_pylist()
            for name, s in zip(names, streams(batch.column(2), batch.column(1).to_pylist()), strict=True):
                rows.append((name, s.hashes, s.start_lines, s.end_lines))
                if len(rows) == 500:
                    yield _token_batch(rows)
                    rows = []
            if rows:
                yield _token_batch(rows)

    return files.select("file", "format", "text").mapInArrow(run, "file string, hashes array<long>, start_lines array<int>, end_lines array<int>")


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), kind))


def _token_batch(rows: list[tuple]) -> pa.RecordBatch:
    names, hashes, starts, ends = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), _lists(list(hashes), pa.int64()), _lists(list(starts), pa.int32()), _lists(list(ends), pa.int32())], names=["file", "hashes", "start_lines", "end_lines"])


def list_arrays(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column, without copies; null is empty."""
    bounds = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def fingerprint_table(tokens: DataFrame, min_tokens: int = C.MIN_TOKENS) -> DataFrame:
    """(file, hashes, ...) -> (fp, file, pos), the postings as flat rows."""
    k, w = gram_and_window(min_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(h, k, w) for h in list_arrays(batch.column(1))]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f, _ in found]))
            fps = np.concatenate([*(f for f, _ in found), np.zeros(0, np.uint64)])
            places = np.concatenate([*(p for _, p in found), np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), batch.column(0).take(rows), pa.array(places, pa.int32())], names=["fp", "file", "pos"])

    return tokens.select("file", "hashes").mapInArrow(run, "fp long, file string, pos int")


def stream_columns(files: DataFrame) -> list[str]:
    """The columns from which batch_streams() reads the streams of files, given as texts or as a token table."""
    return ["format", "text"] if "text" in files.columns else ["hashes", "start_lines", "end_lines"]


def batch_streams(columns: list[pa.Array]) -> Iterator[Stream]:
    """A stream for each row, from the columns that stream_columns() names."""
    if len(columns) == 2:
        yield from streams(columns[1], columns[0].to_pylist())
    else:
        yield from map(Stream, *map(list_arrays, columns))


def distinct_fingerprints(files: DataFrame, min_tokens: int = C.MIN_TOKENS, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(fp, file): each fingerprint of a file once; files as texts or as a token table. `wanted` tells which fingerprints are looked for."""
    k, w = gram_and_window(min_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(winnow(s.hashes, k, w)[0]) for s in batch_streams(batch.columns[1:])]
            found = found if wanted is None else [f[wanted(f)] for f in found]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)), batch.column(0).take(rows)], names=["fp", "file"])

    return files.select("file", *stream_columns(files)).mapInArrow(run, "fp long, file string")


def exploded_tokens(texts: DataFrame, key: str) -> DataFrame:
    """(key, pos, token, line) of prose, in Spark's own expressions: for small tables and cross-checks."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "body"))
    found = lines.select(key, "line", F.posexplode(F.regexp_extract_all("body", F.lit(r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+|[!-/:-@\[-^`{-~]"), F.lit(0))).alias("at", "token"))
    order = Window.partitionBy(key).orderBy("line", "at")
    return found.select(key, (F.row_number().over(order) - 1).alias("pos"), "token", (F.col("line") + 1).alias("line"))


def gram_column(key: str, k: int) -> Column:
    """The digest of the k tokens from each row on, null near the end: a window over exploded tokens."""
    ahead = Window.partitionBy(key).orderBy("pos").rowsBetween(0, k - 1)
    tokens = F.collect_list("token").over(ahead)
    return F.when(F.size(tokens) == k, F.md5(F.array_join(tokens, " ")))


def windowed_fingerprints(tokens: DataFrame, key: str, min_tokens: int) -> DataFrame:
    """(key, fp, pos) by SQL windows: the least (gram, -pos) of each w grams, so the rightmost least one."""
    k, w = gram_and_window(min_tokens)
    grams = tokens.withColumn("gram", gram_column(key, k)).filter("gram is not null")
    back = Window.partitionBy(key).orderBy("pos")
    least = F.min(F.struct("gram", (-F.col("pos")).alias("back"))).over(back.rowsBetween(1 - w, 0))
    chosen = grams.withColumn("least", least).withColumn("n", F.row_number().over(back)).filter(F.col("n") >= w)
    return chosen.select(key, F.col("least.gram").alias("fp"), (-F.col("least.back")).alias("pos")).distinct()


def posting_lists(fingerprints: DataFrame) -> DataFrame:
    """(fp, postings): places by fingerprint, in order."""
    return fingerprints.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("file", "pos"))).alias("postings"))
