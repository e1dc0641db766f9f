"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each leaf block is a state of a chain, main text or not. Scores come from ancestor tags, class and id
name parts and text features, and from pairs of neighbours. The weights maximise the regularised
conditional likelihood of labelled pages (forward-backward gradients, full batch), and pages are decoded
by Viterbi. The labelled pages are made here from many layouts (html_training); training takes seconds on
the driver, has no random part but its seed, and its result (some hundred weights) goes with the tasks.

Defined results: null and empty pages and pages without main text give an empty text; text outside any
element is a block; repeated rows each give a row; an empty table gives an empty result; only id, url and
html are read, so other columns don't matter. Any length of page is read whole; memory follows the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ref
from .html_blocks import Block, Element, features, last_feature, leaf_blocks, places, text_features
from .html_training import labelled_pages

TRAINING_PAGES, TRAINING_SEED = 600, 7
STEPS, RATE, DECAY = 120, 0.5, 1e-3


class ChainModel:
    """Weights by feature name: (other, main); pair[a][b] scores state b after a."""

    def __init__(self, weights: dict[str, tuple[float, float]], pair: list[list[float]]):
        self.weights, self.pair = weights, pair

    def _score(self, names: list[str]) -> tuple[float, float]:
        found = [self.weights[f] for f in names if f in self.weights]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def _path_score(self, element: Element | None) -> tuple[float, float]:
        """The sum over an element and all around it; each element's is computed once."""
        chain = []
        while element is not None and element.score is None:
            chain.append(element)
            element = element.parent
        total = element.score if element else (0.0, 0.0)
        for e in reversed(chain):
            own = self._score(e.own)
            total = e.score = total[0] + own[0], total[1] + own[1]
        return total

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        out = []
        for b, place in zip(blocks, places(len(blocks)), strict=True):
            p, t = self._path_score(b.element), self._score([*text_features(b, place), last_feature(b), "bias"])
            out.append((p[0] + t[0], p[1] + t[1]))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best states by Viterbi; a tie goes to main text."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.pair
        (s0, s1), *rest = self.scores(blocks)
        back = []
        for e0, e1 in rest:
            from_0, from_1 = s1 + ba > s0 + aa, s1 + bb >= s0 + ab
            back.append((from_0, from_1))
            s0, s1 = (s1 + ba if from_0 else s0 + aa) + e0, (s1 + bb if from_1 else s0 + ab) + e1
        states = [int(s1 >= s0)]
        for pointers in reversed(back):
            states.append(int(pointers[states[-1]]))
        return states[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return " ".join(b.text for b, s in zip(blocks, self.decode(blocks), strict=True) if s)


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> ChainModel:
    """Fit to (features by block, state by block) of labelled pages, by adaptive full-batch gradient steps."""
    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                index.setdefault(f, len(index) + 1)
    n, length, width = len(pages), max(len(r) for r, _ in pages), max(len(row) for rows, _ in pages for row in rows)
    x = np.zeros((n, length, width), np.int32)
    y, real = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (rows, states) in enumerate(pages):
        real[i, : len(rows)], y[i, : len(rows)] = True, states
        for k, row in enumerate(rows):
            x[i, k, : len(row)] = [index[f] for f in row]
    w, pair = np.zeros((len(index) + 1, 2)), np.zeros((2, 2))
    seen_w, seen_pair = np.full_like(w, 1e-8), np.full_like(pair, 1e-8)
    gold, follows = np.eye(2)[y] * real[..., None], real[:, 1:]
    gold_pair = np.einsum("nka,nkb->ab", gold[:, :-1] * follows[..., None], gold[:, 1:])
    for _ in range(steps):
        w[0] = 0
        score = w[x].sum(axis=2)
        ahead, behind = np.empty((n, length, 2)), np.zeros((n, length, 2))
        ahead[:, 0] = score[:, 0]
        for k in range(1, length):
            step = np.logaddexp.reduce(ahead[:, k - 1, :, None] + pair, axis=1) + score[:, k]
            ahead[:, k] = np.where(real[:, k, None], step, ahead[:, k - 1])
        for k in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(pair + (score[:, k + 1] + behind[:, k + 1])[:, None, :], axis=2)
            behind[:, k] = np.where(real[:, k + 1, None], step, behind[:, k + 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        likely = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        both = ahead[:, :-1, :, None] + pair + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
        gradient_pair = (gold_pair - (np.exp(both) * follows[..., None, None]).sum(axis=(0, 1))) / n - decay * pair
        error = gold - likely
        gradient = np.stack([np.bincount(x.ravel(), np.repeat(error[..., s].ravel(), width), len(w)) for s in (0, 1)], axis=1) / n - decay * w
        for value, g, seen in ((w, gradient, seen_w), (pair, gradient_pair, seen_pair)):
            seen += g * g
            value += rate * g / np.sqrt(seen)
    return ChainModel({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, pair.tolist())


@lru_cache(maxsize=2)
def trained_model(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> ChainModel:
    return train([_example(page, marked) for page, marked in labelled_pages(pages, seed)])


def _example(page: str, marked: set[str]) -> tuple[list[list[str]], list[int]]:
    blocks = leaf_blocks(page)
    return features(blocks), [int(b.text in marked) for b in blocks]


def extract_main_text(pages: DataFrame, *, model: ChainModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages`; one narrow pass."""
    model = model or trained_model()
    weights, pair = model.weights, model.pair
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = ChainModel(weights, pair)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [chain.main_text(page.as_py()) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    source = pages.select(ref(id_col).cast("long").alias("page_id"), ref(url_col).cast("string").alias("url"), ref(html_col).alias("html"))
    return source.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
