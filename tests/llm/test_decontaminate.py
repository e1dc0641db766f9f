import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import keeps_extra_columns, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from dupweave.llm import decontaminate as D

small = st.lists(st.integers(97, 100), min_size=1, max_size=30)


def least_edits(item, text):
    """Least edits between the item and any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@given(small, small, st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_banded_alignment(item, text, most):
    expected = least_edits(item, text)
    got, end = D.banded_distance(np.array(item, np.uint8), np.array(text, np.uint8), most)
    assert got == expected if expected <= most else got > most
    if got <= most:
        assert 0 <= end <= len(text)


@given(st.text(alphabet="aB \n\té", max_size=40))
@settings(deadline=None)
def test_normalising(text):
    bounds, data = D.normalised(pa.array(["x", text, "y"]))
    assert data[bounds[1] : bounds[2]].tobytes().decode() == " ".join(text.lower().split())


def planted(seed=1, n=60):
    """Texts with items in them, changed by 0 to about 12 % of edits."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    items = [prose(r.randint(8, 50)) for _ in range(8)] + ["tiny one", "ab", "of all the words in this item these are"]
    texts = []
    for _ in range(n):
        item = list(r.choice(items))
        for _ in range(int(len(item) * r.choice([0, 0.01, 0.04, 0.06, 0.12]))):
            k = r.randrange(len(item))
            item[k : k + 1] = r.choice([[], ["z"], [item[k], "q"]])
        texts.append(f"{prose(r.randint(0, 40)).upper()} \n{''.join(item)}  {prose(r.randint(0, 40))}")
    return items, texts


def brute(items, texts):
    out = []
    for t in texts:
        text, found = " ".join((t or "").lower().split()).encode(), {}
        for k, item in enumerate(items):
            own = " ".join(item.lower().split()).encode()
            if not own:
                continue
            if len(own) < D.Q:
                if b" " + own + b" " in b" " + text + b" ":
                    found[k] = 0
                continue
            e = int(len(own) * D.EDIT_SHARE)
            edits = least_edits(own, text)
            if edits <= e:
                found[k] = edits
        out.append(found)
    return out


def test_leaks_are_all_and_only_those_within_the_budget(spark):
    items, texts = planted()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = brute(items, texts)
    got = {r.doc_id: {x.item_id: x.edits for x in r.leaks} for r in D.find_leaks(docs, bench).collect()}
    assert [got[i] for i in range(len(texts))] == expected and 20 < sum(map(bool, expected)) and any(e > 0 for f in expected for e in f.values())
    in_blocks = {r.doc_id: {x.item_id: x.edits for x in r.leaks} for r in D.find_leaks(docs, bench, block_bytes=300).collect()}
    assert in_blocks == got
    assert {r.doc_id for r in D.drop_leaks(docs, bench).collect()} == {i for i, f in enumerate(expected) if not f}


def test_documents_with_items(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plain = lambda s: " ".join(s.lower().split())
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    got = {(r.doc_id, x.item_id) for r in D.find_leaks(docs, bench).collect() for x in r.leaks}
    assert got >= {(r.doc_id, k) for r in docs.collect() for k, t in items.items() if t in plain(r.text)}


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows(spark, odd, none, empty):
    rows = [] if empty else [(1, None), (2, ""), (3, "  "), (None, "one"), (4, "one"), (4, "one"), (5, "word1 word2 word3 word4 word5"), (6, "é ñ ß 漢字")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = D.find_leaks(odd, bench)
    found = sorted((r.doc_id, x.item_id) for r in got.collect() for x in r.leaks)
    assert found == ([] if empty else [(5, 5), (8, 4), (8, 4), (9, 4), (9, 4), (11, 6)]) and got.count() == len(odd_rows()) and keeps_extra_columns(got.collect()) and keeps_extra_columns(D.find_leaks(odd, bench, block_bytes=8).collect())
    assert D.drop_leaks(odd, bench).columns == odd.columns and D.find_leaks(none, bench).isEmpty()


def test_items_of_every_length_have_their_whole_budget():
    r = random.Random(8)
    items, texts = [], []
    for m in list(range(10, 61)) * 3:
        item = "".join(r.choice("abcdefgh ") for _ in range(m - 2))
        items.append(f"x{item}y".replace("  ", " a")[:m])
        own = list(items[-1])
        for _ in range(r.choice([0, int(len(own) * 0.06), int(len(own) * 0.06) + 1])):
            k = r.randrange(1, len(own) - 1)
            own[k : k + 1] = r.choice([[], ["z"], [own[k], "q"]])
        noise = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 60)))
        texts.append(noise() + "".join(own) + noise())
    index = D.ItemIndex(list(range(len(items))), [np.frombuffer(" ".join(i.split()).encode(), np.uint8) for i in items])
    got = [{x["item_id"]: x["edits"] for x in found} for found in index.leaks(pa.array(texts))]
    assert got == brute(items, texts)
    assert sum(17 <= len(" ".join(items[k].split())) <= 19 and e == 1 for f in got for k, e in f.items()) > 0


def test_frequent_grams_are_counted_in_bounded_memory():
    """A line of dashes as an item and long rules in a text."""
    import tracemalloc

    items = ["-" * 400, "-" * 200 + "x" + "-" * 199, "no such text in these lines"]
    texts = ["-" * 80_000, "a " + "-" * 300 + " b", ("-" * 190 + "x" + "-" * 205 + "\n") * 50]
    index = D.ItemIndex([0, 1, 2], [np.frombuffer(i.encode(), np.uint8) for i in items])
    tracemalloc.start()
    got = [{x["item_id"]: x["edits"] for x in found} for found in index.leaks(pa.array(texts))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [{0: 0, 1: 1}, {}, {0: 2, 1: 1}]
    assert peak < 300e6, peak


def test_shared_grams_on_far_diagonals_are_no_leak():
    """Enough q-grams in all, but no band has them."""
    item = "abcdefghijklmnopqrstuvwxyz 0123456789 some further words of it"
    text = " zz ".join(item[i : i + 16] for i in range(0, len(item) - 15, 2))
    index = D.ItemIndex([1], [np.frombuffer(item.encode(), np.uint8)])
    assert index.leaks(pa.array([text, item])) == [[], [{"item_id": 1, "edits": 0, "start": 0, "end": len(item)}]]
