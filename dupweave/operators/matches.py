"""Duplicates that an edit introduces: candidate runs, filters, coverage before the edit, suppression, keys and order.

edits: (edit_id, file, format, before, before_kind, after). before_kind says `content`, `absent` (a new file) or
`unknown` (the indexed version counts, if there is one). Pairs of an edit and a corpus file meet by shared
fingerprints, in groups of rows for a kernel, and what is left per edit are its candidates.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from .diff import TokenDiff, diff_tokens
from .fingerprints import batch_streams, distinct_fingerprints, gram_and_window, gram_hashes, list_arrays, stream_columns, winnow
from .runs import Grams, all_self_runs, among, as_it_is, bitmap, cells, end_to_end, held, n_blocks, numbered_grams, several_files, shared_runs

def trim_partial_lines(start_lines: np.ndarray, end_lines: np.ndarray, start: int, length: int) -> tuple[int, int]:
    """(start, length) without a first or last line of which the run holds no more tokens than it leaves out."""
    end = start + length
    if start and end_lines[start - 1] == start_lines[start]:
        line = start_lines[start]
        inside = int(np.argmax(np.append(start_lines[start:end] != line, True)))
        outside = int(np.argmax(np.append(end_lines[:start][::-1] != line, True)))
        start += inside if inside <= outside else 0
    if start < end < len(start_lines) and start_lines[end] == end_lines[end - 1]:
        line = end_lines[end - 1]
        inside = int(np.argmax(np.append(end_lines[start:end][::-1] != line, True)))
        outside = int(np.argmax(np.append(start_lines[end:] != line, True)))
        end -= inside if inside <= outside else 0
    return start, end - start


def count_new(after: np.ndarray, diff: TokenDiff | None) -> np.ndarray:
    """The number of new tokens before each place of `after`; without a diff all are new."""
    return np.concatenate(([0], np.cumsum(diff.is_new))) if diff else np.arange(len(after) + 1)


class Edit:
    """One edit's streams; what of `after` is new, and whether a run is to be reported.

    `new_before`: the numbers of new tokens before each place, if known; else a diff finds them.
    """

    def __init__(self, after: np.ndarray, start_lines: np.ndarray, end_lines: np.ndarray, before: np.ndarray | None, min_tokens: int, min_lines: int, new_before: np.ndarray | None = None):
        self.after, self.start_lines, self.end_lines, self.before = after, start_lines, end_lines, before
        self.min_tokens, self.min_lines = min_tokens, min_lines
        self.new_before = count_new(after, self.diff) if new_before is None else new_before

    @cached_property
    def diff(self) -> TokenDiff | None:
        return None if self.before is None else diff_tokens(self.after, self.before)

    def has_new(self, start: int, length: int) -> bool:
        return self.new_before[start + length] > self.new_before[start]

    @property
    def hopeless(self) -> bool:
        return len(self.after) < self.min_tokens or not self.new_before[-1]

    def considered(self, region: int, other: int, length: int) -> tuple[int, int, int] | None:
        """The run trimmed to whole lines, if it still counts: (region, other, length)."""
        start, left = trim_partial_lines(self.start_lines, self.end_lines, region, length)
        if left < self.min_tokens or not self.has_new(start, left):
            return None
        lines = self.end_lines[start + left - 1] - self.start_lines[start] + 1
        return (start, other + start - region, left) if lines >= self.min_lines else None

    @cached_property
    def line_edges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token the first one after it that begins on another line, and the first of those before it that end on its last line."""
        n = len(self.after)
        change = np.flatnonzero(np.diff(self.start_lines)) + 1
        ahead = np.append(change, n)[np.searchsorted(change, np.arange(n), "right")]
        change = np.flatnonzero(np.diff(self.end_lines)) + 1
        return ahead, np.append(0, change)[np.searchsorted(change, np.arange(n), "right")]

    def considered_runs(self, found: np.ndarray) -> np.ndarray:
        """What considered() says of rows (region, other, length), without those that don't count."""
        if not len(found):
            return found
        (region, other, length), size, (ahead, back) = found.T, len(self.after), self.line_edges
        start, end = region, region + length
        cut = (start > 0) & (self.end_lines[start - 1] == self.start_lines[start])
        inside = np.minimum(ahead[start], end) - start
        start = start + np.where(cut & (inside <= start - back[start - 1]), inside, 0)
        after = np.minimum(end, size - 1)
        cut = (start < end) & (end < size) & (self.start_lines[after] == self.end_lines[end - 1])
        inside = end - np.maximum(start, back[end - 1])
        end = end - np.where(cut & (inside <= ahead[after] - end), inside, 0)
        left = end - start
        counts = (left >= self.min_tokens) & (self.new_before[end] > self.new_before[np.minimum(start, size)])
        counts &= self.end_lines[end - 1] - self.start_lines[np.minimum(start, size - 1)] + 1 >= self.min_lines
        return np.stack((start, other + start - region, left), axis=1)[counts]

    def met(self, own: Grams, counterpart: Grams, before: Grams | None) -> np.ndarray:
        """Rows (region, other, length) shared with another file, without those whose counterpart was duplicated by `before` already."""
        found = self.considered_runs(shared_runs(own, counterpart, self.min_tokens))
        if not len(found) or before is None:
            return found
        edge = np.zeros(len(counterpart.codes) + self.min_tokens, np.int64)
        known = shared_runs(before, counterpart, self.min_tokens)
        np.add.at(edge, known[:, 1], 1)
        np.add.at(edge, known[:, 1] + known[:, 2], -1)
        total = np.concatenate(([0], np.cumsum(np.cumsum(edge) == 0)))
        return found[total[found[:, 1] + found[:, 2]] - total[found[:, 1]] >= self.min_tokens]

    def cross(self, counterpart: np.ndarray) -> list[tuple[int, int, int]]:
        """Runs shared with another file, without those whose counterpart was duplicated by `before` already."""
        if self.hopeless:
            return []
        own, other, *before = numbered_grams([self.after, counterpart, *([] if self.before is None else [self.before])], self.min_tokens)
        return [tuple(r) for r in self.met(own, other, before[0] if before else None).tolist()]

    def probes(self) -> np.ndarray:
        """The fingerprints of `after` that stand for a window with a new token, as every run that is reported holds one."""
        k, w = gram_and_window(self.min_tokens)
        fps, places = winnow(self.after, k, w)
        new = self.new_before[np.minimum(places + k + w - 1, len(self.after))] > self.new_before[np.maximum(places - w + 1, 0)]
        return np.unique(fps[new])

    def own(self) -> list[tuple[int, int, int]]:
        """Runs within `after`, of one region and length the one with the first counterpart; the region is the later side if that has a new token, else the earlier one."""
        if self.hopeless:
            return []
        kept = np.zeros((0, 3), np.int64)
        for found in all_self_runs(self.after, self.min_tokens):
            p, q, n = found.T
            later = self.new_before[q + n] > self.new_before[q]
            found = self.considered_runs(np.stack((np.where(later, q, p), np.where(later, p, q), n), axis=1))
            kept = np.concatenate((kept, found))
            kept = kept[np.lexsort((kept[:, 1], kept[:, 2], kept[:, 0]))]
            kept = kept[np.concatenate(([True], np.any(kept[1:, [0, 2]] != kept[:-1, [0, 2]], axis=1)))[: len(kept)]]
        if len(kept) and self.before is not None:
            total = np.concatenate(([0], np.cumsum(~self._own_before())))
            kept = kept[total[kept[:, 0] + kept[:, 2]] - total[kept[:, 0]] >= self.min_tokens]
        return [tuple(r) for r in kept.tolist()]

    def _own_before(self) -> np.ndarray:
        """Tokens of `after` that came from a side of a run within `before`; if the diff was capped, by their grams too."""
        covered = np.zeros(len(self.after), bool)
        k, _ = gram_and_window(self.min_tokens)
        sides, known = np.zeros(len(self.before) + 1, np.int64), np.zeros(len(self.before) + 1, np.int64)
        for found in all_self_runs(self.before, self.min_tokens):
            p, q, n = found.T
            for edge, start, length in ((sides, p, n), (sides, q, n), (known, p, n - k + 1)):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
        targets = self.diff.target[np.cumsum(sides)[:-1] > 0]
        covered[targets[targets >= 0]] = True
        if self.diff.capped and known.any():
            grams = gram_hashes(self.before, k)
            within = np.isin(gram_hashes(self.after, k), np.unique(grams[np.cumsum(known)[: len(grams)] > 0]))
            edge = np.zeros(len(self.after) + 1, np.int64)
            at = np.flatnonzero(within)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + k, -1)
            covered |= (np.cumsum(edge)[:-1] > 0) & self.diff.is_new
        return covered


def with_befores(edits: DataFrame, corpus: DataFrame) -> DataFrame:
    """(edit_id, file, format, text, before, before_format, before_hashes) of edits: all of before's are null where all is new.

    An unknown pre-image is the indexed version of the file, joined by name: its text or, from a token table, its hashes.
    """
    edits = edits.filter(F.col("after").isNotNull()).withColumn("text", F.col("after"))
    none, no_hashes = F.lit(None).cast("string"), F.lit(None).cast("array<bigint>")
    kind = F.coalesce("before_kind", F.lit("absent"))
    given = edits.filter(kind != "unknown").select("edit_id", "file", "format", "text", F.when(F.col("before_kind") == "content", F.col("before")).alias("before"), F.col("format").alias("before_format"), no_hashes.alias("before_hashes"))
    texts = "text" in corpus.columns
    found = [F.coalesce("text", F.lit("")), F.col("format"), no_hashes] if texts else [none, none, F.col("hashes")]
    indexed = corpus.select(F.col("file").alias("indexed_file"), *[c.alias(n) for c, n in zip(found, ("before", "before_format", "before_hashes"), strict=True)])
    unknown = edits.filter(kind == "unknown").drop("before").join(indexed, F.coalesce("before_path", "file") == F.col("indexed_file"), "left")
    return given.unionByName(unknown.select(given.columns))


def _befores(texts: pa.Array, formats: pa.Array, hashes: pa.Array) -> Iterator[np.ndarray | None]:
    """The tokens before an edit, from its text or as they are given; None where all is new."""
    given, known = texts.is_valid().to_pylist(), hashes.is_valid().to_pylist()
    rows = zip(batch_streams([formats, texts]), list_arrays(hashes), given, known, strict=True)
    return (s.hashes if is_text else h if is_known else None for s, h, is_text, is_known in rows)


#: The codec of packed rows.
ZSTD = "zstd"


def packed(parts: Iterable[bytes | None]) -> bytes:
    """Parts, some of them none, as one compressed value; what parts share is stored once."""
    parts = list(parts)
    body = b"".join(p for p in parts if p is not None)
    return np.array([len(parts), *(-1 if p is None else len(p) for p in parts)], np.int64).tobytes() + pa.Codec(ZSTD, compression_level=3).compress(body, asbytes=True)


def unpacked(data: bytes) -> list[bytes | None]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8).tolist()
    total = sum(x for x in sizes if x > 0)
    body = pa.Codec(ZSTD).decompress(data[8 * n + 8 :], total, asbytes=True) if total else b""
    out, at = [], 0
    for x in sizes:
        out.append(None if x < 0 else body[at : at + x])
        at += max(0, x)
    return out


def packed_texts(texts: pa.Array) -> pa.Array:
    return pa.array([packed([None if t is None else t.encode()]) for t in texts.to_pylist()], pa.binary())


OWN = "array<struct<region:int,other:int,len:int,start_line:int,end_line:int,other_start:int,other_end:int,key:string>>"
RUN = ["region", "other", "len", "start_line", "end_line", "other_start", "other_end", "key"]
RUN_TYPE = pa.struct([(c, pa.string() if c == "key" else pa.int32()) for c in RUN])


def _run(edit: Edit, file: str | None, path: str | None, r: int, o: int, n: int, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """A run's columns as RUN names them; the key is match_key()'s."""
    parts = (file, path, " ".join(map(str, edit.after[r : r + n].tolist())))
    key = hashlib.md5("\u0001".join(p for p in parts if p is not None).encode()).hexdigest()[:16]
    return r, o, n, int(edit.start_lines[r]), int(edit.end_lines[r + n - 1]), int(starts[o]), int(ends[o + n - 1]), key


def prepared(edits: DataFrame, min_tokens: int, min_lines: int) -> DataFrame:
    """(edit_id, file, new, fps, own, format, before_format, packed) of edits with something new: a bit for each token, the fingerprints to look up, runs within the file, and the texts.

    Here each edit is diffed once, before it meets any counterpart, and read for the last time. edits: from with_befores().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in range(0, whole.num_rows, SLICE):
                yield slice_of(whole.slice(x, SLICE))

    def slice_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, files, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        formats, texts, befores, before_formats = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
        hashes, known = list_arrays(batch.column(6)), batch.column(6).is_valid().to_pylist()
        for i, (s, before) in enumerate(zip(batch_streams(batch.columns[2:4]), _befores(batch.column(4), batch.column(5), batch.column(6)), strict=True)):
            edit = Edit(s.hashes, s.start_lines, s.end_lines, before, min_tokens, min_lines)
            if not edit.hopeless:
                listed = [dict(zip(RUN, _run(edit, files[i], files[i], r, o, n, s.start_lines, s.end_lines), strict=True)) for r, o, n in edit.own()]
                parts = (texts[i].encode(), None if befores[i] is None else befores[i].encode(), hashes[i].tobytes() if known[i] else None)
                rows.append((ids[i], files[i], np.packbits(np.diff(edit.new_before).astype(bool)).tobytes(), edit.probes().view(np.int64), listed, formats[i], before_formats[i], packed(parts)))
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(RUN_TYPE), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["edit_id", "file", "new", "fps", "own", "format", "before_format", "packed"])

    return edits.mapInArrow(run, f"edit_id long, file string, new binary, fps array<long>, own {OWN}, format string, before_format string, packed binary")


def _meeting(ready: DataFrame, corpus: DataFrame, copies: DataFrame, min_tokens: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, edit_id, file, top): groups of edits and contents of files that share fingerprints, and the largest group of each; edit_id is null in the files' rows.

    With a `keep` most of the fingerprints that no edit has are left out before they are shuffled, by a bitmap.
    """
    left = ready.select(F.explode("fps").alias("fp"), "edit_id", "file")
    prune = keep is not as_it_is
    bits = bitmap(left.select("fp")) if prune else None
    right = distinct_fingerprints(corpus, min_tokens, (lambda fps: held(bits, fps)) if prune else None).select("fp", F.lit(None).cast("long").alias("edit_id"), "file")
    side, many = F.col("edit_id").isNotNull(), Window.partitionBy("fp")
    ends = [f(F.when(side == of, F.col("file"))).over(many).alias(name) for f, of, name in ((F.min, True, "a"), (F.max, True, "b"), (F.min, False, "c"), (F.max, False, "d"))]
    # A file doesn't meet itself: what has no other name on the other side goes.
    met = left.unionByName(right).select("*", *ends).filter("a is not null and c is not null").filter(~F.when(side, (F.col("c") == F.col("d")) & (F.col("c") == F.col("file"))).otherwise((F.col("a") == F.col("b")) & (F.col("a") == F.col("file"))))
    named = copies.select("rep", F.explode("members").alias("member"))
    met = met.join(named, (F.col("file") == F.col("member")) & ~side, "left").select("fp", "edit_id", F.coalesce("rep", "file").alias("file")).distinct()
    digest = F.bit_xor(F.coalesce(F.xxhash64("edit_id", F.when(~side, F.col("file"))), F.lit(0).cast("long"))).over(many)
    met = met.withColumn("digest", digest).drop("fp").withColumnRenamed("digest", "fp").distinct().withColumn("weight", F.count(F.lit(1)).over(many))
    return keep(met.withColumn("top", F.max(F.struct("weight", "fp")).over(Window.partitionBy("edit_id", F.when(~side, F.col("file"))))["fp"]).drop("weight"))


def _clusters(met: DataFrame) -> DataFrame:
    """(fp, edit_id, file, edits, files): each edit in the cluster of its largest group, and each file in those of the edits that it shares a group with.

    So an edit's text goes to one cluster, and a file's to fewer than it has groups. edit_id is null in the files' rows; edits and
    files count a cluster's rows. met: from _meeting().
    """
    edited = met.filter("edit_id is not null")
    reached = edited.select("fp", "top").distinct().join(met.filter("edit_id is null").select("fp", "file"), "fp").select(F.col("top").alias("fp"), F.lit(None).cast("long").alias("edit_id"), "file").distinct()
    both = edited.select(F.col("top").alias("fp"), "edit_id", F.lit(None).cast("string").alias("file")).distinct().unionByName(reached)
    counts = [F.count(of).over(Window.partitionBy("fp")).alias(name) for of, name in (("edit_id", "edits"), ("file", "files"))]
    return both.select("*", *counts).filter("edits > 0 and files > 0")


#: Rows that are unpacked or tokenized at once.
SLICE = 256


def candidates(edits: DataFrame, corpus: DataFrame, min_tokens: int = C.MIN_TOKENS, min_lines: int = C.MIN_LINES, keep: Callable[[DataFrame], DataFrame] = as_it_is) -> DataFrame:
    """Reportable runs of each edit, against other files and within the file. Left out are those that suppression drops for certain.

    That are runs of one region and length after the first in order: what suppresses the first suppresses them, or the first does.
    So of files with equal streams only the first counts that isn't the edit's own file. Edits and files meet in clusters of groups
    that share fingerprints, blocks of edits with blocks of files, and no table of pairs is made.
    """
    ready = keep(prepared(with_befores(edits, corpus), min_tokens, min_lines))
    copies = keep(several_files(corpus, min_tokens, with_lines=True))
    met = keep(_clusters(_meeting(ready, corpus, copies, min_tokens, keep)))
    keys = ["fp", "low", "high"]
    lists = ["hashes", "start_lines", "end_lines"]
    kinds = {"edit_id": "long", "new": "binary", "second": "string", "format": "string", "before_format": "string", "packed": "binary", "hashes": "array<bigint>", "start_lines": "array<int>", "end_lines": "array<int>"}
    shaped = lambda df: df.select(*keys, "file", *[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
    own = lambda name, n: F.pmod(F.xxhash64(name), n_blocks(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n_blocks(n) - 1))
    edited = met.filter("edit_id is not null").select("fp", own("edit_id", "edits").alias("low"), every("files").alias("high"), "edit_id")
    rest = met.filter("edit_id is null").select("fp", every("edits").alias("low"), own("file", "files").alias("high"), "file")
    texts, files = ready.select("edit_id", "file", "new", "format", "before_format", "packed"), corpus.select("file", *stream_columns(corpus))
    if keep is not as_it_is:
        texts, files = among(texts, "edit_id", met.filter("edit_id is not null").select("edit_id")), among(files, "file", met.filter("edit_id is null").select("file"))
    if "text" in files.columns:
        files = files.select("file", "format", F.arrow_udf(packed_texts, "binary")("text").alias("packed"))
    left = edited.join(texts, "edit_id")
    seconds = copies.select(F.col("rep").alias("of"), F.col("members")[1].alias("second"))
    right = rest.join(files, "file").join(seconds, F.col("file") == F.col("of"), "left")
    names = ["edit_id", "file", "is_self", "path", *RUN]

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        for x in range(0, batch.num_rows, SLICE):
            yield from read_slice(batch.slice(x, SLICE))

    def read_slice(batch: pa.RecordBatch) -> Iterator[tuple]:
        c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        parts = [[*(unpacked(p) if p is not None else [None]), None, None][:3] for p in c["packed"].to_pylist()]
        texts, befores = (pa.array([None if p[k] is None else p[k].decode() for p in parts], pa.string()) for k in (0, 1))
        told = zip(batch_streams([c["format"], texts]), batch_streams([c[x] for x in lists]), c["hashes"].is_valid().to_pylist(), strict=True)
        earlier = zip(batch_streams([c["before_format"], befores]), parts, strict=True)
        earlier = (s.hashes if p[1] is not None else None if p[2] is None else np.frombuffer(p[2], np.int64) for s, p in earlier)
        return zip(*(c[x].to_pylist() for x in ("file", "edit_id", "new", "second")), earlier, (t if known else s for s, t, known in told), strict=True)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for cell in cells(batches, 3, read):
            place = {row[0]: i for i, row in enumerate(cell) if row[1] is None}
            befores = [i for i, row in enumerate(cell) if row[4] is not None]
            streams = [row[5].hashes for row in cell] + [cell[i][4] for i in befores]
            grams = numbered_grams(streams, min_tokens, sides=np.array([row[1] is None for row in cell] + [False] * len(befores)))
            earlier = {i: grams[len(cell) + k] for k, i in enumerate(befores)}
            others = sorted(place)
            rank = {name: k for k, name in enumerate(others)}
            joined, bounds = end_to_end([grams[place[name]] for name in others], min_tokens)
            for i, (file, edit_id, new, _, before, s) in enumerate(cell):
                if edit_id is None:
                    continue
                new_before = np.concatenate(([0], np.cumsum(np.unpackbits(np.frombuffer(new, np.uint8), count=len(s.hashes)), dtype=np.int64)))
                edit = Edit(s.hashes, s.start_lines, s.end_lines, before, min_tokens, min_lines, new_before)
                found = edit.met(grams[i], joined, earlier.get(i))
                of = np.searchsorted(bounds, found[:, 1], "right") - 1
                paths, ranks = others, np.arange(len(others), dtype=float)
                if (k := rank.get(file)) is not None:
                    # A content that the edit's own file has, too, goes by the next file's name; else the file would meet itself.
                    second = cell[place[file]][3]
                    found, of = (found, of) if second is not None else (found[of != k], of[of != k])
                    paths, ranks[k] = [*others[:k], second, *others[k + 1 :]], k if second is None else bisect_left(others, second) - 0.5
                order = np.lexsort((found[:, 1], ranks[of], found[:, 2], found[:, 0]))
                found, of = found[order], of[order]
                first = np.concatenate(([True], np.any(found[1:, [0, 2]] != found[:-1, [0, 2]], axis=1)))[: len(found)]
                for (r, o, n), k in zip(found[first].tolist(), of[first].tolist(), strict=True):
                    other = cell[place[others[k]]][5]
                    rows.append((edit_id, file, False, paths[k], *_run(edit, file, paths[k], r, o - int(bounds[k]), n, other.start_lines, other.end_lines)))
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.bool_(), pa.string(), *(f.type for f in RUN_TYPE)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)], names=names)

    dealt_out = shaped(left).unionByName(shaped(right)).repartition(*keys).sortWithinPartitions(*keys)
    both = dealt_out.mapInArrow(cross, "edit_id long, file string, is_self boolean, path string, " + ", ".join(f"{c} {'string' if c == 'key' else 'int'}" for c in RUN))
    return both.unionByName(ready.select("edit_id", "file", F.lit(True).alias("is_self"), F.col("file").alias("path"), F.inline("own")))


def without_overlaps(found: Column) -> Column:
    """Of sorted runs, those that no kept one overlaps by more than half of their own length: a fold in order."""
    empty = F.filter(found, lambda c: F.lit(False))

    def overlaps(c: Column) -> Column:
        return lambda k: (F.least(k["region"] + k["len"], c["region"] + c["len"]) - F.greatest(k["region"], c["region"])) * 2 > c["len"]

    return F.aggregate(found, empty, lambda kept, c: F.when(F.exists(kept, overlaps(c)), kept).otherwise(F.concat(kept, F.array(c))))


def match_key(file: Column, other: Column, tokens: Column) -> Column:
    """16 hex digits for the edited file, the counterpart and the duplicated tokens, without line numbers."""
    return F.substring(F.md5(F.concat_ws("\u0001", file, other, F.array_join(F.transform(tokens, lambda t: t.cast("string")), " "))), 1, 16)


def suppressed(found: DataFrame) -> DataFrame:
    """Candidates left after suppression, longest first, others' files before the own one, then by path, region and place."""
    order = F.struct((-F.col("len")).alias("rank"), "is_self", "path", *RUN)
    listed = found.groupBy("edit_id", "file").agg(F.array_sort(F.collect_list(order)).alias("found"))
    return listed.select("edit_id", "file", F.explode(without_overlaps(F.col("found"))).alias("m")).select("edit_id", "file", "m.*").drop("rank")


def new_duplicates(edits: DataFrame, corpus: DataFrame, min_tokens: int = C.MIN_TOKENS, min_lines: int = C.MIN_LINES, keep: Callable[[DataFrame], DataFrame] = as_it_is) -> DataFrame:
    """(edit_id, file, start_line, end_line, other_file, other_start, other_end, tokens, key, place) of what each edit duplicates anew.

    corpus: the token table of the index, or files (file, format, text), which move less; `keep` writes small tables that are
    read several times. place numbers the matches of an edit in their final order.
    """
    kept = suppressed(candidates(edits, corpus, min_tokens, min_lines, keep))
    order = Window.partitionBy("edit_id").orderBy("start_line", "path", "other_start", "region")
    return kept.select("edit_id", "file", "start_line", "end_line", F.col("path").alias("other_file"), "other_start", "other_end", F.col("len").alias("tokens"), "key", F.row_number().over(order).alias("place"))
