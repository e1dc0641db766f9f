import itertools
import random

import numpy as np
import pyarrow as pa
from conftest import keeps_extra_columns, odd_rows

from dupweave.llm import ngram_join as J
from dupweave.llm.components import connected_components
from dupweave.llm.words import shingle_sets, word_slices


def brute(ids, texts, similarity=0.8):
    """Classes and links by comparing all pairs: {row: (class, links, copies)}."""
    sets = []
    for words in word_slices(pa.array(texts, pa.string())):
        bounds, grams = shingle_sets(words)
        sets += [frozenset(grams[bounds[i] : bounds[i + 1]].tolist()) or ((texts[words.first + i] or "").strip() or None) for i in range(words.texts)]
    distinct = [s for s in dict.fromkeys(sets) if s is not None]
    linked = {s: set() for s in distinct}
    for a, b in itertools.combinations([s for s in distinct if isinstance(s, frozenset)], 2):
        if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b) - 1e-9:
            linked[a].add(b)
            linked[b].add(a)
    part, out = {}, []
    for s in distinct:
        if s not in part:
            todo, part[s] = [s], s
            while todo:
                for t in linked[todo.pop()]:
                    if t not in part:
                        part[t] = s
                        todo.append(t)
    members = {}
    for i, s in zip(ids, sets, strict=True):
        if s is not None:
            members.setdefault(part[s], []).append(i)
    for i, s in zip(ids, sets, strict=True):
        if s is None:
            out.append((i, i, 0, 0))
        else:
            known = [x for x in members[part[s]] if x is not None]
            out.append((i, min(known) if known else None, len(linked[s]), sets.count(s) - 1))
    return out


def near_copies(seed, groups=12, most=25):
    """Groups of texts that differ in a few words from a first one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(30, 160))]
        for _ in range(r.randint(1, most)):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return texts


def joined(spark, ids, texts, **options):
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    return sorted((tuple(x) for x in J.ngram_classes(df, **options).collect()), key=repr)


def recall(got, expected):
    """Share of the links that are found, and whether any is made up."""
    a, b = {x[0]: x for x in got}, {x[0]: x for x in expected}
    assert all(a[i][2] <= b[i][2] for i in b)
    return sum(x[2] for x in got) / max(1, sum(x[2] for x in expected))


def test_near_copies_against_all_pairs(spark):
    texts = near_copies(1)
    expected = sorted(brute(range(len(texts)), texts), key=repr)
    got = joined(spark, range(len(texts)), texts)
    assert sum(x[2] for x in expected) > 200 and recall(got, expected) > 0.99
    assert sum(a[1] == b[1] for a, b in zip(got, expected, strict=True)) >= 0.98 * len(texts)


def test_blocks_of_a_node_give_the_same(spark, monkeypatch):
    texts = near_copies(2, groups=3, most=60)
    whole = joined(spark, range(len(texts)), texts)
    monkeypatch.setattr(J, "BLOCK_WEIGHT", 1500)
    monkeypatch.setattr(J, "TASK_SHINGLES", 700)
    assert joined(spark, range(len(texts)), texts) == whole


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    expected = brute([r.doc_id for r in rows], [r.text for r in rows])
    assert sorted(tuple(x) for x in J.ngram_classes(docs).collect()) == sorted(expected)
    kept = J.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {x[1] for x in expected}


def test_odd_rows(spark, odd, none):
    ids, texts = zip(*[(r[0], r[1]) for r in odd_rows()], strict=True)
    assert sorted((tuple(x) for x in J.ngram_classes(odd).collect()), key=repr) == sorted(brute(ids, texts), key=repr)
    kept = J.keep_one_of_each(odd)
    assert keeps_extra_columns(kept.collect())
    assert kept.columns == odd.columns and sorted((r.doc_id or -1, r.text or "")[:2] for r in kept.collect() if r.doc_id in (6, 7, 8, 9)) == [(6, odd_rows()[5][1]), (8, "one")]
    assert J.ngram_classes(none).isEmpty() and J.keep_one_of_each(none).isEmpty()


def test_prefix_is_shortened_to_the_recall():
    depth = J.cut_depth(0.8, 16, 8, 0.995)
    found = lambda k: 1 - (1 - 0.8**k) ** 16
    assert depth < 8 and found(depth) >= 0.995 > found(depth + 1)


def test_verification_counts_shared_shingles():
    r = np.random.default_rng(3)
    for m in (2, 5, 90):
        sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(m)]
        got = J.verify_group(sets, 0.5)
        for i, j in itertools.combinations(range(m), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert got[i, j] == got[j, i] == (both >= 0.5 * (len(sets[i]) + len(sets[j]) - both))


def test_pairs_at_exactly_the_threshold():
    for both in range(4, 4000, 4):
        union = both * 5 // 4
        for left in (0, (union - both) // 2):
            sets = [np.arange(both + left, dtype=np.uint64), np.concatenate((np.arange(both), np.arange(both + left, union))).astype(np.uint64)]
            assert J.verify_group(sets, 0.8)[0, 1], (both, union)
        short = [np.arange(both - 1, dtype=np.uint64), np.arange(union, dtype=np.uint64)]
        assert not J.verify_group(short, 0.8).any(), (both, union)


def test_components_of_chains_stars_and_random_graphs(spark):
    r = random.Random(4)
    edges = [(f"c{r.randrange(10**6):06}x{i}", None) for i in range(30)]
    chain = [e[0] for e in edges]
    pairs = list(zip(chain, chain[1:], strict=False)) + [("hub", f"s{i}") for i in range(50)] + [(f"r{r.randrange(60)}", f"r{r.randrange(60)}") for _ in range(45)] + [(None, "z")]
    got = {x.vertex: x.component for x in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    parent = {v: v for p in pairs if None not in p for v in p}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a and b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {v: find(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string")).isEmpty()


def test_differences_give_the_same_links():
    r = np.random.default_rng(5)
    for m in (2, 6, 60):
        base = np.unique(r.integers(0, 300, 80).astype(np.uint64))
        sets = [np.unique(np.concatenate((r.choice(base, r.integers(1, len(base))), r.integers(0, 300, r.integers(0, 9)).astype(np.uint64)))) for _ in range(m)] + [base]
        found = [J.difference(s, base) for s in sets]
        got = J.verify_group([d for d, _ in found], 0.6, len(base), np.array([len(s) for s in sets]), np.array([k for _, k in found]))
        assert (got == J.verify_group(sets, 0.6)).all()


def test_depth_follows_the_data(spark, monkeypatch):
    """Crowded nodes are cut at the depth of the target recall, sparse ones nearer to the root; links are the same."""
    texts = near_copies(6, groups=2, most=60) + near_copies(7, groups=10, most=4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute(range(len(texts)), texts)

    def depths(sparse):
        monkeypatch.setattr(J, "SPARSE", sparse)
        join = J.NgramJoin(df)
        node = {r.prefix for r in join.nodes().collect()}
        of = [set(), set(), set()]
        for r in join.rows.collect():
            for k, p in enumerate(r.prefixes):
                of[k % 3].add(p)
        assert recall(sorted((tuple(x) for x in join.membership().collect()), key=repr), expected) > 0.99
        return [len(node & x) for x in of]

    assert all(depths(8)) and depths(10**6)[1:] == [0, 0] and depths(1)[:2] == [0, 0]
