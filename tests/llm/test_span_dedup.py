import functools
import random
import re
from collections import defaultdict

import pyarrow as pa
from conftest import keeps_extra_columns, odd_rows

from dupweave.llm import span_dedup as S
from dupweave.llm.words import word_slices

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WORD = re.compile("[A-Za-z0-9_\u0080-\U0010ffff]+")


def brute_sentences(text, value):
    """The numbers of the words at which sentences begin, and the words; `value` is the hash of two words beside a place."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    plain = [text[a:b].translate(LOWER) for a, b in words]
    begins = [i for i in range(len(words)) if i == 0 or re.search("[.!?\n]", text[words[i - 1][1] : words[i][0]])]
    cuts = set(begins)
    for a, b in zip(begins, [*begins[1:], len(words)], strict=True):
        if b - a > S.SENTENCE_WORDS:
            for start in range(a + 1, b - S.CUT_WINDOW + 1):
                cuts.add(min(range(start, start + S.CUT_WINDOW), key=lambda i: (value(plain[i - 1], plain[i]), -i)))
    at = sorted(cuts)
    return at, words


def hashes_of(texts):
    """The chooser, from the kernel's own word hashes."""
    known = {}
    for w in word_slices(pa.array(texts, pa.string()), lower=False):
        for h, a, b in zip(w.hashes.tolist(), w.starts, w.ends, strict=True):
            known[bytes(w.data[a:b]).decode().translate(LOWER)] = h
    import numpy as np

    return functools.cache(lambda a, b: int(S.mix(np.array([known[b]], np.uint64) + np.array([known[a]], np.uint64) * np.uint64(3))[0]))


def brute(rows):
    """Texts after removal, document by document and span by span."""
    chosen = hashes_of([t for _, t in rows])
    places, cut = defaultdict(set), {}
    for i, t in {r for r in rows if r[1] is not None}:
        at, words = brute_sentences(t, chosen)
        cut[i, t] = at, words
        ends = [*at, len(words)]
        for k in range(len(at)):
            e = max(k + S.SPAN_SENTENCES, next((j for j in range(k, len(ends)) if ends[j] >= ends[k] + S.SPAN_WORDS), len(ends)))
            if e < len(ends):
                body = tuple(t[a:b].translate(LOWER) for a, b in words[ends[k] : ends[e]])
                places[body].add((i is None, i, t, k, e))
    gone = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            first = min(found, key=lambda x: (x[0], x[1] or 0, S_key(x[2]), x[3]))
            for x in found:
                if x[:3] != first[:3] or x[3] >= first[4]:
                    gone[x[1], x[2]] |= set(range(x[3], x[4]))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        at, words = cut[i, t]
        starts = [0, *[words[k][0] for k in at[1:]], len(t)] if at else [0, len(t)]
        drop = gone[i, t]
        out.append((i, "".join(t[a:b] for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if k not in drop), len(drop)))
    return out


KEYS = {}


def S_key(text):
    return KEYS[text]


def compare(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    KEYS.update({r.text: r.k for r in df.select("text", F.xxhash64("text").alias("k")).collect()})
    got = S.remove_repeats(df).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=repr) == sorted(brute(rows), key=repr)
    for r in got:
        assert all(x.start < x.end for x in r.removed)
    return got


def planted(seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() + r.choice(["", "", "", "", ",", ".", ".\n", "! "]) for _ in range(n))
    passages = [prose(55), " ".join(word() for _ in range(60)), prose(120)]
    line = prose(12)
    rows = []
    for i in range(40):
        rows.append((i, f"{prose(r.randint(0, 60))} {r.choice([*passages, '', ''])} {line}\n{prose(r.randint(0, 60))}"))
    return rows, passages


def test_planted_passages(spark):
    rows, passages = planted()
    got = {r.doc_id: r for r in compare(spark, rows)}
    for p in passages:
        holders = [i for i, t in rows if p in t]
        assert len(holders) > 2 and got[holders[0]].n_removed == 0
        assert all(got[i].n_removed and p not in got[i].text and sum(x.end - x.start for x in got[i].removed) > 0.6 * len(p) for i in holders[1:])
    clean = [i for i, t in rows if not any(p in t for p in passages)]
    assert all(got[i].text == rows[i][1] for i in clean)


def test_documents(spark, docs):
    compare(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd, none):
    got = S.remove_repeats(odd)
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and "a.b" in got.columns and keeps_extra_columns(rows)
    assert {r.text for r in rows if r.doc_id == 6} == {odd_rows()[5][1]} and all(r.text is None for r in rows if r.doc_id == 1) and [r.text for r in rows if r.doc_id == 5] == [odd_rows()[4][1]]
    assert all(len(r.text) < len(odd_rows()[5][1]) for r in rows if r.doc_id == 7)
    assert S.remove_repeats(none).isEmpty()


def prose_of(r, word, n, low, high):
    """Words in sentences of `low` to `high` words."""
    out = []
    while len(out) < n:
        out += [word() for _ in range(r.randint(low, high))]
        out[-1] += "."
    return out[:n]


def test_every_passage_of_51_words_holds_a_span_wherever_it_stands():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 7)))

    def found(text):
        (w,) = word_slices(pa.array([text]), lower=False)
        return {*S.spans(w)[3].tolist()}

    for low, high in ((1, 4), (8, 16), (12, 16), (14, 16), (13, 14), (15, 15), (16, 16), (60, 90), (17, 40), (1, 40)):
        for _ in range(150):
            passage = " ".join(prose_of(r, word, r.randint(0, 20) + 51, low, high)[-51:])
            hosts = [" ".join([*prose_of(r, word, r.randint(1, 40), low, high), passage, *prose_of(r, word, r.randint(1, 40), low, high)]) for _ in range(2)]
            assert found(hosts[0]) & found(hosts[1]), passage
    for period in range(1, 12):
        passage = " ".join(([word() for _ in range(period)] * 60)[:51])
        assert found(f"one two {passage} three four") & found(f"five {passage} six. seven")


def test_no_repeated_run_of_51_words_is_left_whole(spark):
    """Runs found by brute force: each run of 51 words in two documents loses words in all but the first of them."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    source = prose_of(r, word, 1500, 5, 30)
    rows = []
    for i in range(80):
        start = r.randrange(1400)
        rows.append((i, " ".join([*prose_of(r, word, r.randint(0, 50), 5, 30), *source[start : start + r.randint(51, 90)], *prose_of(r, word, r.randint(0, 50), 5, 30)])))
    got = {x.doc_id: x.text for x in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    runs = defaultdict(set)
    bare = lambda t: re.findall("[a-z]+", t)
    for i, t in rows:
        w = bare(t)
        for k in range(len(w) - 50):
            runs[tuple(w[k : k + 51])].add(i)
    repeated = {k: v for k, v in runs.items() if len(v) > 1}
    assert len(repeated) > 300
    for run, holders in repeated.items():
        left = [i for i in holders if " ".join(run) in " ".join(bare(got[i]))]
        assert len(left) <= 1 and all(i == min(holders) for i in left)


def test_periodic_texts_keep_their_first_words(spark):
    words = lambda k, n: " ".join(f"{k}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    rows = [(1, "alike " * 308), (2, words("w", 200)), (3, f"{words('x', 30)}. " + "one two three " * 200), (4, "alike " * 100)]
    got = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 20 <= len(got[1].text.split()) <= 50 and 20 <= len(got[3].text.split()) - 30 <= 60 and len(got[4].text.split()) < 50
    assert got[2].text == rows[1][1] and got[2].n_removed == 0
    for r in got.values():
        text, out, last = rows[r.doc_id - 1][1], "", 0
        for x in r.removed:
            out, last = out + text[last : x.start], x.end
        assert out + text[last:] == r.text
