"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m bytes (lower case, single spaces) leaks into a text if some part of the text is within
e = floor(EDIT_SHARE * m) edits of it. Such a part shares at least m - q + 1 - q * e q-grams with the item,
all on diagonals that differ by e at most. q is Q, or as much less as an item needs for that bound to be above zero.
Shared q-grams are counted in overlapping bands of 2 * (e + 1) diagonals, each band starting e + 1 after the one
before, so one band holds them all. Neighbouring bands that meet the bound are one region, verified by a banded
alignment of the whole item against it. Nothing is sampled or cut. Matches of frequent q-grams are counted
MATCHES_AT_ONCE at a time and regions are aligned in overlapping pieces, so memory doesn't follow their number.

The items' q-grams go with the tasks. Their size is summed up first. Up to BLOCK_BYTES, all items go at once: one
narrow pass. More come in blocks of about that size by a hash of their id, one look at the texts for each block: its
leaks are written down by id and text before the next block is fetched, so that no more than one block is on the
driver or in a task, and joined to the texts at the end.

Defined results: null and blank items match nothing; items shorter than Q bytes match only as exact parts between
spaces or ends; items that repeat are each reported, items with a null id never; null and empty texts have no leaks; an
empty benchmark or table gives no leaks or rows; rows that repeat id and text have the same leaks; input columns named
`leaks` are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ref, shared_folder
from .words import IS_SPACE, U, mix, powers, slices, text_bytes

Q = 10
EDIT_SHARE = 0.06
BLOCK_BYTES = 4 << 20
FILTER_BITS = 22
MATCHES_AT_ONCE = 1 << 20
REGION_BYTES = 1 << 16


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts in lower case, with one space for each run of ASCII white space and none outside."""
    offsets, data = text_bytes(pc.utf8_lower(texts.cast(pa.large_utf8())))
    space = IS_SPACE[data]
    inner = np.zeros(len(data) + 1, bool)
    inner[offsets] = True
    keep = ~space
    # A space stays if the byte before it is none, and it isn't the first of its text.
    keep[1:] |= space[1:] & ~space[:-1] & ~inner[1:-1]
    ends = np.concatenate(([0], np.cumsum(keep)))
    out = np.where(space, 32, data)[keep].astype(np.uint8)
    bounds = ends[offsets]
    last = np.flatnonzero((np.diff(bounds) > 0) & (out[np.maximum(bounds[1:] - 1, 0)] == 32)) if len(out) else np.zeros(0, np.int64)
    if len(last):
        drop = np.zeros(len(out), np.int64)
        drop[bounds[last + 1] - 1] = 1
        bounds = bounds - np.concatenate(([0], np.cumsum(drop)))[bounds]
        out = out[drop == 0]
    return bounds, out


def gram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The hash of the q bytes from each place that has them."""
    if len(data) < q:
        return np.zeros(0, U)
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[:-1], dtype=U)))
    return mix((sums[q:] - sums[:-q]) * down[: len(data) - q + 1])


def banded_distance(item: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int]:
    """Least edits between `item` and any part of `region`, and where that part ends; most + 1 if above `most`.

    Parts may begin anywhere: the band is the region's length minus the item's, plus `most` on either side.
    """
    m, n = len(item), len(region)
    if n < m - most:
        return most + 1, 0
    width = n - m + 2 * most + 1
    # Cell k of row i is column i + k - most.
    columns = np.arange(width) - most
    big = m + n + 1
    row = np.where((columns >= 0) & (columns <= n), 0, big)
    steps = np.arange(width)
    padded = np.concatenate((np.full(most + 1, -1), region, np.full(width + m, -1))).astype(np.int16)
    for i in range(1, m + 1):
        at = columns + i
        differ = padded[i : i + width] != item[i - 1]
        new = np.minimum(row + differ, np.append(row[1:], big) + 1)
        new[(at < 0) | (at > n)] = big
        if i <= most:
            new[most - i] = i
        new = np.minimum.accumulate(new - steps) + steps
        new[at > n] = big
        row = new
        if row.min() > most:
            return most + 1, 0
    k = int(row.argmin())
    return int(row[k]), int(k - most + m)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class GramIndex:
    """The q-grams of some items, sorted by hash, for one q."""

    def __init__(self, items: list[np.ndarray], numbers: list[int], edits: np.ndarray, q: int):
        self.items, self.q, self.edits = items, q, edits
        self.numbers = np.array(numbers, np.int64)
        self.least = np.array([len(items[k]) - q + 1 - q * int(edits[k]) for k in numbers], np.int64)
        self.own_edits = edits[self.numbers]
        grams = [gram_hashes(items[k], q) for k in numbers]
        hashes = np.concatenate([*grams, np.zeros(0, U)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> U(64 - FILTER_BITS)] = True

    def regions(self, bounds: np.ndarray, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first band, last band) of neighbouring bands with at least the item's bound of shared q-grams."""
        hashes = gram_hashes(data, self.q)
        at = np.flatnonzero(self.filter[hashes >> U(64 - FILTER_BITS)])
        left, right = np.searchsorted(self.hashes, hashes[at], "left"), np.searchsorted(self.hashes, hashes[at], "right")
        text = np.searchsorted(bounds, at, "right") - 1
        good = (right > left) & (at + self.q <= bounds[text + 1])
        at, left, many, text = at[good], left[good], (right - left)[good], text[good]
        if not len(at):
            return []
        # Few pairs of text and item share enough q-grams at all: count by pair, then the places of those by band.
        keys, counts = self._counts(at, left, many, text, bounds, None)
        wanted = keys[counts >= self.least[keys % len(self.numbers)]]
        if not len(wanted):
            return []
        bands, counts = self._counts(at, left, many, text, bounds, wanted)
        # A match counts for its own band and for the one before, which overlaps it.
        keys, counts = counted(np.concatenate((bands, bands - 1)), np.concatenate((counts, counts)))
        pair, band = keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31)
        full = counts >= self.least[pair % len(self.numbers)]
        pair, band = pair[full], band[full]
        if not len(pair):
            return []
        first = np.concatenate(([True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1] + 1)))
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(pair)) - 1
        return [(int(p) // len(self.numbers), int(self.numbers[int(p) % len(self.numbers)]), int(a), int(b)) for p, a, b in zip(pair[starts], band[starts], band[ends], strict=True)]

    def _counts(self, at, left, many, text, bounds, wanted) -> tuple[np.ndarray, np.ndarray]:
        """Matches by pair of text and item, or with `wanted`, by such a pair and band: some matches at a time."""
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(many)))
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(total, total[low] + MATCHES_AT_ONCE, "right")) - 1)
            n = many[low:high]
            which = np.repeat(left[low:high], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, own = self.item[which], np.repeat(text[low:high], n)
            key = own * len(self.numbers) + item
            if wanted is not None:
                keep = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                diagonal = (np.repeat(at[low:high] - bounds[text[low:high]], n) - self.place[which])[keep]
                key = key[keep] << 32 | diagonal // (self.own_edits[item[keep]] + 1) + (1 << 31)
            found = counted(key, np.ones(len(key), np.int64))
            keys, counts = counted(np.concatenate((keys, found[0])), np.concatenate((counts, found[1])))
            low = high
        return keys, counts


class ItemIndex:
    """Items and their q-grams, by the q that each item's edit budget allows."""

    def __init__(self, ids: list[int], items: list[np.ndarray], q: int = Q, share: float = EDIT_SHARE):
        self.ids, self.items = ids, items
        sizes = [len(i) for i in items]
        self.edits = np.array([int(s * share) for s in sizes], np.int64)
        own_q = [min(q, s // (int(e) + 1)) if s >= q else 0 for s, e in zip(sizes, self.edits, strict=True)]
        self.indexes = [GramIndex(items, [k for k, x in enumerate(own_q) if x == one], self.edits, one) for one in sorted(set(own_q) - {0})]
        self.short = [k for k, s in enumerate(sizes) if 0 < s < q]
        self.text = [i.tobytes() for i in items]

    def leaks(self, texts: pa.Array) -> list[list[dict]]:
        """For each text its leaks: item id, edits, and where the part begins and ends (bytes of the normalised text)."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for a, b in slices(text_bytes(texts)[0]):
            found = out[a:b]
            self._slice(*normalised(texts.slice(a, b - a)), found)
        for found in out:
            found.sort(key=lambda x: (x["item_id"], x["edits"], x["start"]))
        return out

    def _slice(self, bounds: np.ndarray, data: np.ndarray, out: list[list[dict]]) -> None:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for index in self.indexes:
            for text, item, first, last in index.regions(bounds, data):
                e, m = int(self.edits[item]), len(self.items[item])
                low, high = max(0, first * (e + 1) - e), min(int(bounds[text + 1] - bounds[text]), (last + 2) * (e + 1) + m + e)
                found = self._align(item, data[bounds[text] + low : bounds[text] + high])
                if found[0] <= e:
                    best[text, item] = min(best.get((text, item), (e + 1, 0)), (found[0], low + found[1]))
        for (text, item), (edits, end) in best.items():
            out[text].append({"item_id": self.ids[item], "edits": edits, "start": max(0, end - len(self.items[item])), "end": end})
        if self.short:
            for text in range(len(bounds) - 1):
                own = b" " + data[bounds[text] : bounds[text + 1]].tobytes() + b" "
                for item in self.short:
                    if (at := own.find(b" " + self.text[item] + b" ")) >= 0:
                        out[text].append({"item_id": self.ids[item], "edits": 0, "start": at, "end": at + len(self.text[item])})

    def _align(self, item: int, region: np.ndarray) -> tuple[int, int]:
        """Least edits and the first end of a part of `region` with that many, in pieces that overlap by a part's length."""
        e, m = int(self.edits[item]), len(self.items[item])
        exact = region.tobytes().find(self.text[item])
        if exact >= 0 or not e:
            return (0, exact + m) if exact >= 0 else (e + 1, 0)
        best = e + 1, 0
        for a in range(0, max(1, len(region) - m - e), REGION_BYTES):
            edits, end = banded_distance(self.items[item], region[a : a + REGION_BYTES + m + e], e)
            best = min(best, (edits, a + end))
        return best


LEAKS = "array<struct<item_id:bigint,edits:int,start:int,end:int>>"


KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def block_items(items: DataFrame, blocks: int, k: int) -> tuple[list[int], list[np.ndarray]]:
    """Ids and normalised texts of the k-th of `blocks` blocks of (item_id, text); blank ones are left out."""
    own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    bounds, data = normalised(own.column("text").combine_chunks() if own.num_rows else pa.array([], pa.string()))
    ids = own.column("item_id").to_pylist()
    filled = [i for i in range(len(ids)) if bounds[i + 1] > bounds[i]]
    return [ids[i] for i in filled], [data[bounds[i] : bounds[i + 1]].copy() for i in filled]


def _finder(ids: list[int], items: list[np.ndarray], q: int, share: float):
    held: list[ItemIndex] = []

    @F.arrow_udf(LEAKS)
    def leaks(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(ItemIndex(ids, items, q, share))
        return pa.array(held[0].leaks(texts), KIND)

    return leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES, doc_id_col: str = "doc_id", id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """`docs` with `leaks`: for each leaked item its id, edits, start and end."""
    spark = docs.sparkSession
    items = benchmark.select(ref(id_col).cast("long").alias("item_id"), ref(text_col).alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    kept = [ref(c) for c in docs.columns if c.lower() != "leaks"]
    text = F.coalesce(ref(text_col), F.lit(""))
    if blocks == 1:
        return docs.select(*kept, _finder(*block_items(items, 1, 0), q, share)(text).alias("leaks"))
    folder = shared_folder(spark, "leaks")
    named = docs.select(ref(doc_id_col).cast("string").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    for k in range(blocks):
        found = named.select("id", "key", _finder(*block_items(items, blocks, k), q, share)("text").alias("leaks"))
        found.filter(F.size("leaks") > 0).dropDuplicates(["id", "key"]).write.parquet(f"{folder}/{k}")
    p = fresh(docs, "leak")
    every = spark.read.schema(f"id string, key long, leaks {LEAKS}").parquet(*[f"{folder}/{k}" for k in range(blocks)]).groupBy("id", "key").agg(F.sort_array(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    every = every.select(F.col("id").alias(f"{p}id"), F.col("key").alias(f"{p}key"), F.col("leaks").alias(f"{p}leaks"))
    same = ref(doc_id_col).cast("string").eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(text) == F.col(f"{p}key"))
    return docs.join(every, same, "left").select(*kept, F.coalesce(F.col(f"{p}leaks"), F.array().cast(LEAKS)).alias("leaks"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` into which no item leaks, unchanged."""
    packed = docs.select(F.struct(*[ref(c) for c in docs.columns]).alias("_row"), ref("doc_id").alias("doc_id"), ref("text").alias("text"))
    return find_leaks(packed, benchmark, **options).filter(F.size("leaks") == 0).select("_row.*")
