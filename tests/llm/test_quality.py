import math
import re

import numpy as np
import pyarrow as pa
from conftest import keeps_extra_columns, odd_rows
from pyspark.sql import functions as F

from dupweave.llm import quality as Q
from dupweave.llm import queries
from dupweave.llm.words import BASE, mix

SF = "/root/testdata/sf0.1"


def test_features_do_not_depend_on_the_batch():
    texts = ["Some words, some MORE words!", None, "", "é ñ 漢字 some", "x " * 3000, "Some words, some MORE words!"]

    def found(batch):
        out = []
        for _, bounds, numbers in Q.text_features(pa.array(batch, pa.string())):
            out += [tuple(numbers[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
        return out

    together = found(texts)
    assert together == [found([t])[0] for t in texts] and together[0] == together[5] and together[1] == together[2] == ()
    assert all(list(x) == sorted(set(x)) for x in together)


def test_fit_orders_grades_and_thresholds():
    r = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(600):
        dull, bad = r.random() < 0.5, r.random() < 0.3
        rows.append(sorted({*(r.integers(100, 400, 20).tolist()), *([7] if dull else []), *([9] if bad else [])}))
        grades.append(2 - int(dull) - int(bad))
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    model = Q.fit(bounds, np.concatenate(rows).astype(np.int64), np.array(grades))
    weight = dict(zip(model.numbers.tolist(), model.weights, strict=True))
    assert weight[7] < -1 and weight[9] < -1 and max(weight.values()) < 0 and (np.diff(model.thresholds) >= 0).all()
    p = Q._at_most(np.linspace(-20, 20, 50), model.thresholds)
    assert (np.diff(p, axis=1) >= -1e-12).all() and (np.diff(p[:, 1:-1], axis=0) <= 1e-12).all()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) == 0
    model = Q.train(docs, labels.filter(~held))
    scored = Q.score_quality(docs, model).join(labels.filter(held), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.avg("expected_grade").alias("grade")).collect()
    by = {(r.quality, r.toxic): r for r in scored}
    assert by[1, 0].kept > 0.96 and by[1, 1].kept < 0.25 and by[0, 0].kept < 0.1 and by[1, 0].grade > 1.9 > by[1, 1].grade


def test_sample_is_bounded_and_the_same_in_reruns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one, two = (sorted(r._label_id for r in Q.labelled_sample(d, labels, 50).select("_label_id").collect()) for d in (docs, docs.repartition(5)))
    assert one == two and len(one) == 50
    a, b = Q.train(docs, labels, 300), Q.train(docs.repartition(5), labels, 300)
    assert (a.numbers == b.numbers).all() and np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)


def test_sample_is_bounded_where_an_id_repeats(spark):
    docs = spark.createDataFrame([(i % 7 if i % 2 else 3, f"text {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(3, 1, 1)] * 20, "doc_id long, quality int, toxic int")
    for rows in (1, 3, 10, 100):
        assert Q.labelled_sample(docs, labels, rows).count() <= rows
    assert {(r._label_id, r._text) for r in Q.labelled_sample(docs, labels, 100).collect()} == {(r.doc_id, r.t) for r in docs.groupBy("doc_id").agg(F.min("text").alias("t")).collect()}


def test_gradient_is_that_of_the_likelihood():
    """By differences, and the likelihood by its formula, document by document."""
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 12, r.integers(0, 8))) for _ in range(40)]
    bounds, x = np.concatenate(([0], np.cumsum([len(k) for k in rows]))), np.concatenate(rows)
    grades, w, cuts = r.integers(0, 3, 40), r.normal(0, 1, 12), np.array([-1.3, 0.4])

    def plain(w, cuts):
        total = 0.0
        for own, grade in zip(rows, grades, strict=True):
            at_most = [0.0, *(1 / (1 + math.exp(sum(w[k] for k in own) - t)) for t in cuts), 1.0]
            total -= math.log(at_most[grade + 1] - at_most[grade])
        return total / len(grades)

    value, g_w, g_t = Q.likelihood(w, cuts, x, bounds, grades)
    assert abs(value - plain(w, cuts)) < 1e-12
    step = lambda a, k: a + 1e-6 * (np.arange(len(a)) == k)
    assert all(abs((plain(step(w, k), cuts) - plain(step(w, k) - 2e-6 * (np.arange(12) == k), cuts)) / 2e-6 - g_w[k]) < 1e-6 for k in range(12))
    assert all(abs((plain(w, step(cuts, k)) - plain(w, step(cuts, k) - 2e-6 * (np.arange(2) == k))) / 2e-6 - g_t[k]) < 1e-6 for k in range(2))


def test_query_against_brute_force(spark):
    """Each document's score from its words one by one, with the fitted weights."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.train(docs, labels)
    weight = dict(zip(model.numbers.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    bucket = lambda value, kind: int(Q._bucket(np.array([value % 2**64], np.uint64), kind)[0])

    def polynomial(word):
        return int(mix(np.array([sum((b + 1) * pow(BASE, i, 2**64) for i, b in enumerate(word)) % 2**64], np.uint64))[0])

    def raw(word):
        return sum((b + 1) * pow(BASE, i, 2**64) for i, b in enumerate(word))

    rows = docs.collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:120]:
        text = r.text or ""
        words = [w.encode() for w in re.findall("[A-Za-z0-9_\u0080-\U0010ffff]+", text.lower())]
        found = {bucket(polynomial(w), 1) for w in words} | {bucket(raw(w[:5]), 2) for w in words}
        if words:
            found.add(bucket((math.floor(math.log2(len(words)) * 2) + 1) * 1000 + 999, 3))
        counts = [text.encode().count(bytes([m])) for m in Q.MARKS.tolist()] + [len(re.findall("[A-Z]", text)), len(words) - len({bucket(polynomial(w), 1) for w in words})]
        for k, n in enumerate(counts):
            if n and (step := math.floor(math.log2(n / max(1, len(words)) * 64 + 1) * 2)):
                found.add(bucket(step * 1000 + k, 3))
        score = sum(weight.get(f, 0.0) for f in found) if found else model.average
        at_most = [1 / (1 + math.exp(max(-40, min(40, score - t)))) for t in model.thresholds]
        assert abs(got[r.doc_id].tail - (1 - at_most[-1])) < 1e-9 and abs(got[r.doc_id].expected_grade - sum(1 - p for p in at_most)) < 1e-9
        assert got[r.doc_id].keep == (got[r.doc_id].tail >= Q.KEEP_TAIL)


def test_empty_texts_score_as_the_average(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "  \n")], "doc_id long, text string")
    tails = {r.tail for r in Q.score_quality(odd, model).collect()}
    best = Q.score_quality(docs, model).agg(F.max("tail")).first()[0]
    assert len(tails) == 1 and abs(tails.pop() - (1 - Q._at_most(np.array([model.average]), model.thresholds)[0, -2])) < 1e-12 < best - 1e-3


def test_long_clean_texts_are_kept_as_often(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0
    model = Q.train(docs, labels.filter(~held))
    clean = Q.score_quality(docs, model).join(labels.filter(held).filter("quality = 1 AND toxic = 0"), "doc_id")
    long = F.size(F.split("text", " ")) > 1000
    kept = {r.long: r.kept for r in clean.groupBy(long.alias("long")).agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert kept[True] > 0.95 and kept[False] > 0.97, kept


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 1), (7, None, 0), (None, 1, 1), (8, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    no_labels = labels.filter("doc_id = 99")
    for model in (Q.train(odd, labels), Q.train(odd, no_labels), Q.train(none, labels)):
        rows = Q.score_quality(odd, model).collect()
        assert keeps_extra_columns(rows) and len(rows) == len(odd_rows()) and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
        assert len({r.tail for r in rows if r.doc_id == 6}) == 1
        assert Q.score_quality(none, model).isEmpty() and Q.keep_good(odd, model).columns == odd.columns
    assert Q.keep_good(odd, Q.train(odd, no_labels)).count() == len(odd_rows())
