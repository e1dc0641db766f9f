"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after `.`, `!`, `?` before the next word, and at line ends. A sentence of over
SENTENCE_WORDS words is cut again before chosen words: of each CUT_WINDOW neighbouring places within it, the one with
the least hash of the words on its two sides, the last of equal ones. So no sentence is longer than SENTENCE_WORDS,
and a cut is seen from the words around it alone. From each sentence starts a span: the fewest sentences, at least
SPAN_SENTENCES, that hold SPAN_WORDS words. Every span's hash is joined globally; the first place of a repeated span
(least id, then text, then position) stays, and the sentences that any other place covers are removed. A place that
overlaps the first one in the same text stays, too.

Every repeated passage of PASSAGE_WORDS words holds a span that is the same wherever it stands: a cut that both texts
make lies within SENTENCE_WORDS words of the passage's begin, so does one of its end, all cuts between are the same,
and 2 * SENTENCE_WORDS + SPAN_WORDS < PASSAGE_WORDS.

Shuffles: each span's hash once to find repeats (counts combine before it), each span once to look its repeat up,
repeated ones once more to meet their first place, and each text once to be rewritten. Repeats are
checkpointed; a span that a third of all texts share is one row there, and Spark splits the other side of the joins.

Defined results: null texts stay null, empty texts empty; letter case of ASCII and all punctuation and white
space are ignored in comparing; rows that repeat id and text are one document and get the same text; nulls
in the id come last; an empty table gives an empty result; input columns named like the output columns
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, fresh, ref
from .words import GRAM, U, Words, mix, word_slices

SENTENCE_WORDS = 12
CUT_WINDOW = 11
SPAN_SENTENCES = 2
SPAN_WORDS = 26
PASSAGE_WORDS = 51
#: A place is the number of a span's first sentence and, in its last bits, how many it has: SPAN_WORDS at most.
COUNT_BITS = 8

ENDS_SENTENCE = np.zeros(256, np.int64)
ENDS_SENTENCE[[*b".!?\n"]] = 1


def sentence_starts(words: Words) -> np.ndarray:
    """The word numbers at which sentences begin, in order."""
    n = len(words.hashes)
    if not n:
        return np.zeros(0, np.int64)
    marks = np.concatenate(([0], np.cumsum(ENDS_SENTENCE[words.data])))
    begins = np.zeros(n, bool)
    begins[1:] = marks[words.starts[1:]] > marks[words.ends[:-1]]
    begins[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
    at = np.flatnonzero(begins)
    length = np.diff(np.append(at, n))
    # Windows of places before words a + 1 ... a + CUT_WINDOW, for each word a that has them in its own long sentence.
    left = np.repeat(np.append(at[1:], n), length) - np.arange(n)
    windows = np.flatnonzero(np.repeat(length > SENTENCE_WORDS, length) & (left > CUT_WINDOW))
    if len(windows):
        h = np.zeros(n, U)
        h[1:] = mix(words.hashes[1:] + words.hashes[:-1] * U(3))
        least, chosen = h[windows + 1], np.ones(len(windows), np.int64)
        for k in range(2, CUT_WINDOW + 1):
            value = h[windows + k]
            better = value <= least
            least = np.where(better, value, least)
            chosen[better] = k
        begins[windows + chosen] = True
        at = np.flatnonzero(begins)
    return at


def spans(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first sentence in the text, number of sentences, hash) of every span, and the sentences' first words."""
    at = sentence_starts(words)
    n = len(words.hashes)
    text = np.searchsorted(words.bounds, at, "right") - 1
    first_of_text = np.searchsorted(at, words.bounds)
    index = np.arange(len(at))
    # The end, in sentences, of the shortest span from each.
    next_word = np.append(at, n)
    end = np.maximum(np.searchsorted(next_word, at + SPAN_WORDS), index + SPAN_SENTENCES)
    good = end <= first_of_text[text + 1] if len(at) else np.zeros(0, bool)
    index, end, text = index[good], end[good], text[good]
    # A polynomial over the word hashes from the span's first word to its last.
    up = np.cumprod(np.full(n + 1, GRAM[0], U), dtype=U) if n else np.zeros(1, U)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(words.hashes * up[:n], dtype=U)))
    inverse = U(pow(int(GRAM[0]), -1, 1 << 64))
    down = np.cumprod(np.full(n + 1, inverse, U), dtype=U)
    a, b = next_word[index], next_word[end]
    hashes = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U))
    return text, index - first_of_text[text], end - index, hashes, at


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in word_slices(batch.column(2), lower=False):
            text, first, count, hashes, _ = spans(words)
            rows = pa.array(text + words.first)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first << COUNT_BITS | count)], names=["span", "doc_id", "text_key", "place"])


def _word_bytes(words: Words, text: int) -> np.ndarray:
    """Where the words of a text begin in its bytes, and its end; the first takes what stands before it."""
    begins = words.starts[words.bounds[text] : words.bounds[text + 1]] - words.offsets[text]
    if len(begins):
        begins[0] = 0
    return np.append(begins, words.offsets[text + 1] - words.offsets[text])


def remove_places(texts: pa.Array, places: pa.Array) -> tuple[list[str | None], list[int], list[int], list[list[dict]]]:
    """Texts without what their places cover, numbers of sentences and of those that lose words, removed ranges in code points."""
    out, total, gone, ranges = texts.to_pylist(), [0] * len(texts), [0] * len(texts), [[] for _ in range(len(texts))]
    for words in word_slices(texts, lower=False):
        at = sentence_starts(words)
        per = np.diff(np.searchsorted(at, words.bounds))
        for t in range(words.texts):
            r = words.first + t
            total[r] = int(per[t])
            own = places[r].values
            if own is None or not len(own):
                continue
            own = own.to_numpy()
            begins = _word_bytes(words, t)
            sentence = np.append(at[np.searchsorted(at, words.bounds[t]) :][: per[t]], words.bounds[t + 1]) - words.bounds[t]
            first = own >> COUNT_BITS
            edge = np.zeros(len(begins), np.int64)
            np.add.at(edge, sentence[first], 1)
            np.add.at(edge, sentence[first + (own & (1 << COUNT_BITS) - 1)], -1)
            covered = np.cumsum(edge)[:-1] > 0
            data = words.data[words.offsets[t] : words.offsets[t + 1]].tobytes()
            gone[r] = int(np.logical_or.reduceat(covered, sentence[:-1]).sum())
            kept, last, chars = [], 0, 0
            flips = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
            for a, b in zip(begins[flips[::2]], begins[flips[1::2]], strict=True):
                lead, cut = data[last:a].decode(), data[a:b].decode()
                kept.append(lead)
                chars += len(lead)
                ranges[r].append({"start": chars, "end": chars + len(cut)})
                chars += len(cut)
                last = b
            out[r] = "".join(kept) + data[last:].decode()
    return out, total, gone, ranges


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) -> (doc_id, text_key, places): all places of repeated spans but the first ones."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select("doc_id", "text_key", "text").mapInArrow(_span_rows, "span long, doc_id long, text_key long, place long")
    where = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "place")
    # Cut here and below: the joins then read both sides from exchanges of their own, which Spark can split where a span is hot.
    repeated = rows.groupBy("span").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("span").alias("r")).checkpoint()
    rows = rows.join(repeated, F.col("span") == F.col("r")).drop("r").checkpoint()
    once = rows.groupBy("span").agg(F.min(where).alias("first")).select(F.col("span").alias("s"), "first").checkpoint()
    begin = lambda place: F.shiftright(place, COUNT_BITS)
    first_end = begin(F.col("first.place")) + F.col("first.place").bitwiseAND((1 << COUNT_BITS) - 1)
    overlaps = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (begin(F.col("place")) < first_end)
    other = rows.join(once, F.col("span") == F.col("s")).filter(~overlaps)
    return other.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("places"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the text rewritten, and `n_sentences`, `n_removed` and `removed` (ranges of the old text in code points)."""
    p = fresh(docs, "s")
    key, ident = F.xxhash64(ref(text_col)), ref(id_col).cast("long")
    places = repeated_places(docs.select(ident.alias("doc_id"), key.alias("text_key"), ref(text_col).alias("text")))
    places = places.select(*[F.col(c).alias(f"{p}{c}") for c in ("doc_id", "text_key", "places")])
    joined = docs.withColumn(f"{p}id", ident).withColumn(f"{p}key", key).join(places, F.col(f"{p}id").eqNullSafe(F.col(f"{p}doc_id")) & (F.col(f"{p}key") == F.col(f"{p}text_key")), "left")
    kind = pa.struct([("text", pa.string()), ("n_sentences", pa.int32()), ("n_removed", pa.int32()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf("struct<text:string,n_sentences:int,n_removed:int,removed:array<struct<start:int,end:int>>>")
    def rewrite(texts: pa.Array, found: pa.Array) -> pa.Array:
        columns = remove_places(texts, found)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))

    rewritten = joined.withColumn(f"{p}new", rewrite(ref(text_col), F.col(f"{p}places")))
    clash = {"n_sentences", "n_removed", "removed"}
    kept = [F.col(f"{p}new.text").alias(c) if c == text_col else ref(c) for c in docs.columns if c.lower() not in clash]
    return rewritten.select(*kept, *[F.col(f"{p}new.{c}").alias(c) for c in ("n_sentences", "n_removed", "removed")])
