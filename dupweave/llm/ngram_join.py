"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

A text is the set of its runs of five words; two texts are linked when the sets' Jaccard similarity is 0.8
or more. Equal sets are one class from the start. Each of TREES trees is a prefix trie of the sets' signatures
(min-hashes in a fixed order); a node is all sets with one prefix. Matching begins at the longest prefixes that
a pair at the threshold still shares in some tree with probability RECALL, and each set's prefix is shortened, node
by node, down to SHALLOW as long as no more than SPARSE sets come together. So crowded parts of a trie are cut at
the depth that the target recall allows, sparse parts nearer to the root, where recall is higher. Sets below one cut
node are candidates, and nodes of several trees with the same sets below are looked at once.

Verification is exact and no pair is a row. Texts meet their node's representative (its least set) once: what leaves
that task is how each set differs from it. The differences of a node go in blocks of bounded size, each two blocks
meet in one task, and the task takes all pairs' intersection sizes from the differences (a product of incidence
matrices) and returns, per set, its number of links and the least set of its part of the link graph. A pair counts
in the first tree that it shares. The parts' stars are joined to classes by connected components. So a group of any
size is spread over tasks of bounded memory, texts aren't copied for its blocks, and its output is linear in its size;
no bucket is capped.

Defined results: texts of fewer than five words are one run of all of them; texts without words are
copies of texts that are the same but for outer white space; null and blank texts are classes of their own; rows
that repeat id and text are copies of each other; a null id is never the least of a class unless all are
null; an empty table gives an empty result; only id and text are read, other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, ref
from .components import connected_components
from .words import U, mix, shingle_sets, word_slices

SIMILARITY = 0.8
NGRAM = 5
TREES, DEPTH, RECALL = 16, 8, 0.995
SHALLOW, SPARSE = 3, 32
#: Of texts that meet a representative in one task, in shingles, but for at least TASK_SETS texts, so that copies of the
#: representative stay few beside them; of differences in one block, each set with SET_WEIGHT.
TASK_SHINGLES, TASK_SETS = 50_000, 8
BLOCK_WEIGHT, SET_WEIGHT = 200_000, 200
COLUMNS_AT_ONCE = 8192


def cut_depth(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, `depth` at most, that some tree shares of a pair at `similarity` with probability `recall`."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def _multipliers(n: int, seed: int = 11) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def prefixes(bounds: np.ndarray, sets: np.ndarray, trees: int, shallow: int, deep: int) -> np.ndarray:
    """For each non-empty set and tree, numbers for the first `shallow` to `deep` min-hashes; the tree is in the top bits."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(full), trees, deep - shallow + 1), np.int64)
    if not len(full):
        return out
    starts = bounds[full]
    for tree, block in enumerate(_multipliers(trees * deep).reshape(trees, deep)):
        h = np.full(len(full), U(tree + 1))
        for k, m in enumerate(block, 1):
            least = np.minimum.reduceat(sets * m, starts)
            h = mix(h * U(0x100000001B3) ^ least)
            if k >= shallow:
                out[:, tree, k - shallow] = (h >> U(8)).astype(np.int64) | tree << 56
    return out


def _signatures(trees: int, shallow: int, deep: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("sid", pa.binary()), ("n", pa.int32()), ("prefixes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for words in word_slices(texts):
                bounds, sets = shingle_sets(words, NGRAM)
                n = np.diff(bounds)
                sums = [np.concatenate((np.zeros(1, U), np.cumsum(mix(sets + U(k)), dtype=U))) for k in (1, 2)]
                ids = np.stack([mix(s[bounds[1:]] - s[bounds[:-1]] + n.astype(U)) for s in sums], axis=1)
                sid = [i.tobytes() for i in ids.astype(">u8")]
                for i in np.flatnonzero(n == 0):
                    plain = (texts[words.first + int(i)].as_py() or "").strip()
                    sid[i] = hashlib.md5(plain.encode()).digest() if plain else None
                trie = prefixes(bounds, sets, trees, shallow, deep)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((n > 0) * trees * (deep - shallow + 1)))), pa.int32()), pa.array(trie.ravel(), pa.int64()))
                own = batch.slice(words.first, words.texts)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(sid, pa.binary()), pa.array(n, pa.int32()), lists], schema=schema)

    return run


MINUS = U(0x5851F42D4C957F2D)


def difference(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, int]:
    """How a sorted set differs from another: what only it has, and marked, what only the other has; how many the latter are."""
    plus, minus = np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)
    return np.concatenate((plus, minus ^ MINUS)), len(minus)


def verify_group(sets: list[np.ndarray], similarity: float, base: int = 0, sizes: np.ndarray | None = None, missing: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of sets reach `similarity`: a symmetric boolean matrix without its diagonal.

    With `base`, `sets` are differences from a set of that size, and two sets share all of it but what either misses, and
    what they have besides: |A n B| = base - missing A - missing B + |differences shared|.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64) if sizes is None else sizes
    missing = np.zeros(m, np.int64) if missing is None else missing
    lengths = np.array([len(s) for s in sets], np.int64)
    values, row = np.concatenate([*sets, np.zeros(0, U)]), np.repeat(np.arange(m), lengths)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1
    row, column = row[shared], column[shared]
    column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64)))) if len(column) else column
    both = np.zeros((m, m), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS_AT_ONCE, COLUMNS_AT_ONCE))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = np.zeros((m, COLUMNS_AT_ONCE if m > 64 else int(column[b - 1]) - k * COLUMNS_AT_ONCE + 1 if b > a else 1), np.float32)
        part[row[a:b], column[a:b] - k * COLUMNS_AT_ONCE] = 1
        both += part @ part.T
    # In float64, where a pair at exactly `similarity` differs from the bound by rounding only.
    shared = both.astype(np.float64) + (base - missing[:, None] - missing[None, :])
    linked = shared * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) * (1 - 1e-12)
    np.fill_diagonal(linked, False)
    return linked


def _least_in_part(linked: np.ndarray) -> np.ndarray:
    """For each row, the least row of its connected part."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by node, its representative first: each set's difference from that one; rows that repeat a set go."""
    schema = pa.schema([("prefix", pa.int64()), ("sid", pa.binary()), ("tries", pa.list_(pa.int64())), ("n", pa.int64()), ("base", pa.int64()), ("missing", pa.int64()), ("other", pa.list_(pa.int64()))])
    key, base, seen = None, np.zeros(0, U), None
    for batch in batches:
        nodes, salts, is_rep, sids = (batch.column(k).to_pylist() for k in range(4))
        for words in word_slices(batch.column(5)):
            bounds, sets = shingle_sets(words, NGRAM)
            at, sizes, missing, others = [], [], [], []
            for t in range(words.texts):
                r = words.first + t
                own = sets[bounds[t] : bounds[t + 1]]
                if (nodes[r], salts[r]) != key:
                    key, base, seen = (nodes[r], salts[r]), own.copy(), None
                if sids[r] == seen or is_rep[r] and salts[r]:
                    continue
                seen = sids[r]
                other, miss = difference(own, base)
                at.append(r)
                sizes.append((len(own), len(base)))
                missing.append(miss)
                others.append(other)
            edges = np.concatenate(([0], np.cumsum([len(o) for o in others], dtype=np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([*others, np.zeros(0, U)]).view(np.int64)))
            part = batch.take(pa.array(at, pa.int64()))
            n, of_base = np.array(sizes, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(4), pa.array(n), pa.array(of_base), pa.array(missing, pa.int64()), lists], schema=schema)


def _verify(similarity: float, trees: int):
    schema = pa.schema([("sid", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def group(prefix: int, i: int, j: int, rows: list[tuple]) -> Iterator[tuple[bytes, int, bytes]]:
        if len(rows) < 2:
            return
        rows = sorted(rows, key=lambda r: r[0])
        sids, block, n, base, missing, own, others = zip(*rows, strict=True)
        linked = verify_group(list(others), similarity, base[0], np.array(n), np.array(missing))
        if i != j:
            linked &= np.not_equal.outer(block, block)
        before = np.zeros_like(linked)
        tries = np.zeros((len(rows), trees), np.int64)
        for k, nodes in enumerate(own):
            tries[k, nodes >> 56] = nodes
        for tree in range(prefix >> 56):
            before |= (tries[:, None, tree] == tries[None, :, tree]) & (tries[:, tree] != 0)
        links, least = (linked & ~before).sum(axis=1), _least_in_part(linked)
        for k in np.flatnonzero(linked.any(axis=1)):
            yield sids[k], int(links[k]), sids[least[k]]

    def flush(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            plain = [batch.column(k).to_pylist() for k in range(8)]
            lists = []
            for column in (batch.column(8), batch.column(9)):
                values, edges = column.values.to_numpy(), column.offsets.to_numpy()
                lists.append([values[a:b].copy() for a, b in zip(edges[:-1], edges[1:], strict=True)])
            for prefix, i, j, block, sid, n, base, missing, own, other in zip(*plain, *lists, strict=True):
                if (prefix, i, j) != key:
                    if key:
                        out += group(*key, rows)
                    key, rows = (prefix, i, j), []
                    if len(out) > 5000:
                        yield flush(out)
                        out = []
                rows.append((sid, block, n, base, missing, own, other.view(U)))
        if key:
            out += group(*key, rows)
        if out:
            yield flush(out)

    return run


class NgramJoin:
    """The join of one table with itself. `rows` (id, text key, set id, trie prefixes) and `sets` are checkpointed."""

    def __init__(self, docs: DataFrame, *, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text"):
        ensure_checkpoint_dir(docs.sparkSession)
        self.similarity, self.trees = similarity, trees
        self.deep = cut_depth(similarity, trees, depth, recall)
        self.shallow = min(SHALLOW, self.deep)
        self.source = docs.select(ref(id_col).cast("long").alias("doc_id"), F.xxhash64(ref(text_col)).alias("text_key"), ref(text_col).alias("text"))
        schema = "doc_id long, text_key long, sid binary, n int, prefixes array<long>"
        self.rows = self.source.mapInArrow(_signatures(trees, self.shallow, self.deep), schema).checkpoint()
        #: One row a set; the first row (by id, null last, and text) stands for it.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
        self.sets = self.rows.filter("sid is not null").groupBy("sid").agg(first, F.count(F.lit(1)).alias("copies"), F.min("prefixes").alias("prefixes"), F.min("n").alias("n")).checkpoint()
        self.links = self._links().checkpoint()

    def nodes(self) -> DataFrame:
        """(sid, n, prefix): the cut nodes that hold more than one set, by set and tree."""
        levels = self.deep - self.shallow + 1
        trees = F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree")
        prefix = lambda level: F.get("prefixes", F.col("tree") * levels + level).alias("prefix")
        left, cut = self.sets.filter("n > 0").select("sid", "n", trees, "prefixes").select("sid", "n", "tree", prefix(0)), None
        for level in range(levels):
            # Cut here: the join then reads both sides from exchanges of their own, which Spark can split where a node is crowded.
            count = left.groupBy(F.col("prefix").alias("node")).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").checkpoint()
            met = left.join(count, F.col("prefix") == F.col("node")).select("sid", "n", "tree", "prefix", "m").checkpoint()
            sparse = (met if level == levels - 1 else met.filter(F.col("m") <= SPARSE)).select("sid", "n", "prefix")
            cut = sparse if cut is None else cut.unionByName(sparse)
            if level < levels - 1:
                crowded = met.filter(F.col("m") > SPARSE).select("sid", "n", "tree")
                if crowded.isEmpty():
                    break
                left = crowded.join(self.sets.select("sid", "prefixes"), "sid").select("sid", "n", "tree", prefix(level + 1))
        return cut

    def _links(self) -> DataFrame:
        """(sid, links, root) for each task and set with a link there."""
        nodes = self.nodes()
        h = [F.bit_xor(F.xxhash64("sid", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
        full = nodes.groupBy("prefix").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), F.min("sid").alias("rep"), *h)
        once = full.groupBy("m", "x1", "x2").agg(F.min(F.struct("prefix", "size", "rep")).alias("node")).select("m", "node.*")
        tasks = F.least(F.ceil(F.col("size") / TASK_SHINGLES), F.ceil(F.col("m") / TASK_SETS)).cast("int").alias("tasks")
        once = once.select(F.col("prefix").alias("own"), tasks, "rep")
        looked = F.when(F.col("own").isNotNull(), F.struct("prefix", "tasks", (F.col("sid") == F.col("rep")).alias("is_rep")))
        members = nodes.join(once, F.col("prefix") == F.col("own"), "left").groupBy("sid").agg(F.collect_list("prefix").alias("tries"), F.collect_list(looked).alias("nodes"))
        wanted = members.join(self.sets.select("sid", "first"), "sid").select("sid", "tries", "nodes", F.col("first.doc_id").alias("own_id"), F.col("first.text_key").alias("own_key"))
        same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
        found = self.source.join(wanted, same).select("sid", "tries", "text", F.explode("nodes").alias("node")).select("node.*", "sid", "tries", "text")
        salt = F.when(F.col("is_rep"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("sid"), F.col("tasks")).cast("int")))
        dealt = found.withColumn("salt", F.explode(salt)).select("prefix", "salt", "is_rep", "sid", "tries", "text")
        dealt = dealt.repartition("prefix", "salt").sortWithinPartitions("prefix", "salt", F.col("is_rep").desc(), "sid")
        differ = dealt.mapInArrow(_differences, "prefix long, sid binary, tries array<long>, n long, base long, missing long, other array<long>").checkpoint()

        weight = F.sum(F.size("other") + SET_WEIGHT)
        large = differ.groupBy(F.col("prefix").alias("large")).agg(F.ceil(weight / BLOCK_WEIGHT).cast("int").alias("blocks")).filter("blocks > 1")
        placed = differ.join(large, F.col("prefix") == F.col("large"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = placed.select("prefix", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "sid", "n", "base", "missing", "tries", "other")
        met = met.repartition("prefix", "i", "j").sortWithinPartitions("prefix", "i", "j")
        return met.mapInArrow(_verify(self.similarity, self.trees), "sid binary, links long, root binary")

    def classes(self) -> DataFrame:
        """(sid, component, links, copies, first, class): one row a set."""
        parts = connected_components(self.links.select(F.col("sid").alias("a"), F.col("root").alias("b")))
        counts = self.links.groupBy(F.col("sid").alias("linked")).agg(F.sum("links").alias("links"))
        named = self.sets.select("sid", "first", "copies").join(counts, F.col("sid") == F.col("linked"), "left").join(parts, F.col("sid") == F.col("vertex"), "left")
        named = named.select("sid", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "sid").alias("component")).checkpoint()
        least = named.groupBy("component").agg(F.min("first").alias("class"))
        return named.join(least, "component")

    def membership(self) -> DataFrame:
        """(doc_id, class_id, n_links, n_copies) for each row: the class's first id, links to other texts, other rows with this set."""
        classes = self.classes().select(F.col("sid").alias("s"), F.col("class.doc_id").alias("class_id"), "links", "copies")
        joined = self.rows.select("doc_id", "sid").join(classes, F.col("sid") == F.col("s"), "left")
        alone = F.col("sid").isNull()
        return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"))

    def first_rows(self) -> DataFrame:
        """(doc_id, text_key) of the row that stays of each class; rows without a class all stay."""
        kept = self.classes().filter(F.col("first") == F.col("class")).select("first.doc_id", "first.text_key")
        return kept.unionByName(self.rows.filter("sid is null").select("doc_id", "text_key"))


def ngram_classes(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of `docs`: doc_id, class_id, n_links, n_copies."""
    return NgramJoin(docs, **options).membership()


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the first document of each class, its columns unchanged; of rows that repeat id and text one stays."""
    kept = NgramJoin(docs, **options).first_rows().select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key")).distinct()
    packed = docs.select(F.struct(*[ref(c) for c in docs.columns]).alias("_row"), ref("doc_id").cast("long").alias("_id"), F.xxhash64(ref("text")).alias("_key"))
    joined = packed.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key")), "left_semi")
    return joined.dropDuplicates(["_id", "_key"]).select("_row.*")
