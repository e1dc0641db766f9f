"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is its quality mark plus one if it isn't toxic (0 to 2). One set of weights over hashed
text features gives a score s, ordered thresholds t_0 < t_1 give P(grade <= k) = 1 / (1 + exp(s - t_k)), and
from these come the expected grade and the tail probability P(grade >= 2) that selection uses. Features are
the distinct words, their first five bytes, steps of the rates of ASCII marks, capitals and repeats, and the
text's size in steps; the whole text counts. Only features whose documents' mean grade lies LEAST_EFFECT standard
errors from the overall mean take part, so that the many common words of a long text don't add up to anything.
Words can only speak against a text, rates and sizes, of which a text has few, also for it. The fit (L1-regularised
adaptive proximal gradient, from zero) is deterministic.

Fitting uses at most SAMPLE_ROWS labelled rows, those with the least hash of their id: a bound that doesn't
grow with the data. Scoring is one narrow pass with vectorised batches.

Defined results: labels with a null are left out; of documents that repeat a labelled id the least text counts; without
any label all documents score alike and are kept; null and empty texts have no features and score as the fitted
documents do on average; repeated rows score alike; an empty table gives an empty result; input columns named like the
output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ref
from .words import U, IS_WORD, mix, powers, sorted_unique, text_bytes, word_slices

BITS = 18
SAMPLE_ROWS = 8000
LEAST_DOCUMENTS = 4
LEAST_EFFECT = 4.5
L1 = 2e-4
STEPS = 150
GRADES = 3
KEEP_TAIL = 0.65
MARKS = np.array([b for b in range(33, 127) if not IS_WORD[b]])


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(hashes + U(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(64 - BITS)).astype(np.int64)


def text_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the texts: (first text, bounds by text, distinct feature numbers)."""
    offsets, raw = text_bytes(texts)
    for words in word_slices(texts):
        n, count = words.texts, np.diff(words.bounds)
        up, down = powers(len(words.data) + 1)
        sums = np.concatenate((np.zeros(1, U), np.cumsum((words.data.astype(U) + U(1)) * up[:-1], dtype=U)))
        heads = (sums[np.minimum(words.ends, words.starts + 5)] - sums[words.starts]) * down[words.starts]
        text = words.text_of_word()
        pairs = [text << BITS | _bucket(words.hashes, 1), text << BITS | _bucket(heads, 2)]
        distinct = sorted_unique(pairs[0])
        repeats = count - np.bincount(distinct >> BITS, minlength=n)
        own = raw[offsets[words.first] : offsets[words.first + n]]
        of_byte = np.repeat(np.arange(n), np.diff(offsets[words.first : words.first + n + 1]))
        table = np.zeros((n, len(MARKS) + 2), np.int64)
        column = np.full(256, -1)
        column[MARKS] = np.arange(len(MARKS))
        column[ord("A") : ord("Z") + 1] = len(MARKS)
        marked = column[own] >= 0
        table += np.bincount(of_byte[marked] * table.shape[1] + column[own[marked]], minlength=table.size).reshape(table.shape)
        table[:, -1] = repeats
        # A step of size for a text of any words; 0 is none.
        size = np.floor(np.log2(np.maximum(count, 1)) * 2).astype(np.int64) + 1
        sized = np.flatnonzero(count)
        pairs.append(sized << BITS | _bucket((size[sized] * 1000 + 999).astype(U), 3))
        rate = np.where(table > 0, np.floor(np.log2(np.maximum(table, 1) / np.maximum(count, 1)[:, None] * 64 + 1) * 2), 0).astype(np.int64)
        doc, col = np.nonzero(rate)
        pairs.append(doc << BITS | _bucket((rate[doc, col] * 1000 + col).astype(U), 3))
        pairs = sorted_unique(np.concatenate((distinct, *pairs[1:])))
        yield words.first, np.searchsorted(pairs >> BITS, np.arange(n + 1)), pairs & (1 << BITS) - 1


def signed_features() -> np.ndarray:
    """Whether a feature number may speak for a text: those of rates and sizes."""
    out = np.zeros(1 << BITS, bool)
    out[_bucket((np.arange(80)[:, None] * 1000 + np.append(np.arange(len(MARKS) + 2), 999)).ravel().astype(U), 3)] = True
    return out


@dataclass
class OrdinalModel:
    """Weights of the features in `numbers`, the ordered thresholds, and the mean score of the fitted documents."""

    numbers: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    average: float = 0.0

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.numbers] = self.weights
        return w


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _at_most(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= k) for each threshold, with 0 before and 1 after."""
    inner = 1 / (1 + np.exp(np.clip(scores[:, None] - thresholds, -40, 40)))
    return np.concatenate((np.zeros((len(scores), 1)), inner, np.ones((len(scores), 1))), axis=1)


def telling_features(bounds: np.ndarray, numbers: np.ndarray, grades: np.ndarray, least: float = LEAST_EFFECT) -> np.ndarray:
    """The features of some, not all, documents whose mean grade differs from that of all by `least` standard errors."""
    n = len(grades)
    documents = np.bincount(numbers, minlength=1 << BITS)
    total = np.bincount(numbers, np.repeat(grades, np.diff(bounds)), 1 << BITS)
    apart = np.abs(total / np.maximum(documents, 1) - grades.mean()) * np.sqrt(documents) / max(grades.std(), 1e-9)
    return np.flatnonzero((documents >= LEAST_DOCUMENTS) & (documents < n) & (apart >= least))


def likelihood(w: np.ndarray, cuts: np.ndarray, x: np.ndarray, rows: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades, and its gradients by the weights and the thresholds."""
    n = len(grades)
    p = _at_most(_sums(w[x], rows), cuts)
    high, low = p[np.arange(n), grades + 1], p[np.arange(n), grades]
    d_high, d_low = high * (1 - high), low * (1 - low)
    likely = np.maximum(high - low, 1e-9)
    g_w = np.bincount(x, np.repeat((d_high - d_low) / likely / n, np.diff(rows)), len(w))
    g_t = [(-(d_high / likely)[grades == k].sum() + (d_low / likely)[grades == k + 1].sum()) / n for k in range(len(cuts))]
    return float(-np.log(likely).mean()), g_w, np.array(g_t)


def fit(bounds: np.ndarray, numbers: np.ndarray, grades: np.ndarray, steps: int = STEPS, l1: float = L1) -> OrdinalModel:
    """The regularised maximum-likelihood model of documents given as feature numbers by row."""
    if not len(grades):
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.array([-4.0, -3.0]))
    used = telling_features(bounds, numbers, grades)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    keep = place[numbers] >= 0
    x, rows = place[numbers[keep]], np.concatenate(([0], np.cumsum(keep)))[bounds]
    counts = np.bincount(grades, minlength=GRADES) + 1.0
    share = np.cumsum(counts)[:-1] / counts.sum()
    cuts = np.log(share / (1 - share))
    most = np.where(signed_features()[used], np.inf, 0.0)
    w = np.zeros(len(used))
    seen_w, seen_t = np.full(len(used), 1e-10), np.full(len(cuts), 1e-10)
    for _ in range(steps):
        _, g_w, g_t = likelihood(w, cuts, x, rows, grades)
        seen_w += g_w * g_w
        seen_t += g_t * g_t
        rate = 0.3 / np.sqrt(seen_w)
        w = w - rate * g_w
        w = np.minimum(np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0), most)
        cuts = np.maximum.accumulate(cuts - 0.3 / np.sqrt(seen_t) * g_t + np.arange(len(cuts)) * 1e-9)
    kept = np.flatnonzero(w)
    return OrdinalModel(used[kept], w[kept], cuts, float(_sums(w[x], rows).mean()))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(grade, text) of at most `rows` labels, one text for each; the bounded list of ids is broadcast."""
    graded = labels.select(F.col("doc_id").alias("_label_id"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("_grade")).dropna().filter(f"_grade between 0 and {GRADES - 1}")
    chosen = graded.orderBy(F.xxhash64("_label_id"), "_label_id", "_grade").limit(rows)
    found = docs.select(ref("doc_id").alias("_id"), F.coalesce(ref("text"), F.lit("")).alias("_text")).join(F.broadcast(chosen.distinct()), F.col("_id") == F.col("_label_id"))
    return found.groupBy("_label_id", "_grade").agg(F.min("_text").alias("_text"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on a bounded sample; what reaches the driver are the sample's feature numbers."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bounds, numbers in text_features(batch.column(2)):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(numbers, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lists)), batch.column(1).slice(first, len(lists)), lists], names=["id", "grade", "numbers"])

    found = labelled_sample(docs, labels, rows).mapInArrow(numbered, "id long, grade int, numbers array<int>").toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    lists = found.column("numbers").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = np.array([len(x) for x in lists], np.int64)
    return fit(np.concatenate(([0], np.cumsum(sizes))), lists.flatten().to_numpy(zero_copy_only=False), found.column("grade").to_numpy().astype(np.int64))


def score_quality(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text", keep_tail: float = KEEP_TAIL) -> DataFrame:
    """`docs` with `expected_grade`, `tail` (probability of the highest grade) and `keep`."""
    numbers, weights, cuts, average = model.numbers, model.weights, model.thresholds, model.average
    kind = pa.struct([("expected_grade", pa.float64()), ("tail", pa.float64())])

    @F.arrow_udf("struct<expected_grade:double,tail:double>")
    def grade(texts: pa.Array) -> pa.Array:
        w = OrdinalModel(numbers, weights, cuts).dense()
        scores = np.zeros(len(texts))
        for first, bounds, found in text_features(texts):
            scores[first : first + len(bounds) - 1] = np.where(np.diff(bounds) > 0, _sums(w[found], bounds), average)
        p = _at_most(scores, cuts)
        return pa.StructArray.from_arrays([pa.array((1 - p[:, 1:-1]).sum(axis=1)), pa.array(1 - p[:, -2])], fields=list(kind))

    g = fresh(docs, "grade")
    kept = [ref(c) for c in docs.columns if c.lower() not in ("expected_grade", "tail", "keep")]
    scored = docs.withColumn(g, grade(F.coalesce(ref(text_col), F.lit(""))))
    return scored.select(*kept, F.col(f"{g}.expected_grade").alias("expected_grade"), F.col(f"{g}.tail").alias("tail"), (F.col(f"{g}.tail") >= keep_tail).alias("keep"))


def keep_good(docs: DataFrame, model: OrdinalModel, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The rows of `docs` that the classifier accepts, unchanged."""
    flag = fresh(docs, "keep")
    only = docs.withColumn(flag, F.struct(*[ref(c) for c in docs.columns])).select(flag, ref("text").alias("text"))
    return score_quality(only, model, keep_tail=keep_tail).filter("keep").select(f"{flag}.*")
