"""Quality classifier (operator 10): n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

Indicators are hashed words, pairs of words, and runs of one to three word shapes (letters, capitals, digits, marks,
length, the same as one of the two words before), so that texts in words never seen still share them. The scaled rows,
brought to length one, are fitted by dual coordinate descent; margins on rows left out of a first fit give the logistic
curve from margin to score.

Training reads at most SAMPLE labelled rows, drawn by a hash of the id; scoring reads every whole text. Nothing but
the text enters a score.

Edge cases: a NULL text counts as empty; a text without words has no indicator but the constant and gets its score;
without labelled rows of both classes every score is the share of label 1 (0.5 if there are no labels); ids with
labels that disagree count as the larger label; NULL labels and NULL ids are not learned from; a NULL id is not held
out; repeated rows are each returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import LOWER, fields, mixed, pieces, word_hashes, word_spans

SAMPLE = 6000  # labelled rows learned from
BITS = 18  # hashed indicators
ACCEPT = 0.7
_CLASS = np.zeros(256, np.uint16)  # what a byte says about its word
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 8
for _i, _c in enumerate((b".,;:", b"!?", b"$%&*#@", b"|", b"'\"()-")):
    _CLASS[list(_c)] = 16 << _i
_CLASS[(_CLASS == 0) & (np.arange(256) > 32) & (np.arange(256) < 127)] = 512


def indicators(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every distinct indicator of each text, sorted."""
    row, begin, end = word_spans(data, at)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = word_hashes(LOWER[data], begin, end)
    kinds = _CLASS[data]
    edges = np.stack([begin, end], 1).ravel()
    shape = np.bitwise_or.reduceat(np.append(kinds, np.uint16(0)), edges)[::2].astype(np.uint64)
    shape |= (kinds[begin] == 2).astype(np.uint64) << np.uint64(10)
    shape |= np.minimum(np.log2(end - begin).astype(np.uint64), np.uint64(5)) << np.uint64(11)
    for back in (1, 2):
        again = np.zeros(len(row), bool)
        again[back:] = (word[back:] == word[:-back]) & (row[back:] == row[:-back])
        shape |= again.astype(np.uint64) << np.uint64(13 + back)
    prime = np.uint64(0x9E3779B97F4A7C15)
    found = [(row, mixed(word)), (row, mixed(shape + np.uint64(1 << 20)))]
    for gap, grams in ((1, (word, shape)), (2, (shape,))):
        same = row[gap:] == row[:-gap]
        for g in grams:
            h = g[:-gap].copy() if gap == 1 else mixed(g[:-2] * prime + g[1:-1])
            found.append((row[gap:][same], mixed(h * prime + g[gap:] + np.uint64(gap))[same]))
    keys = np.concatenate([r * (1 << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64) for r, h in found])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys >> BITS, keys & ((1 << BITS) - 1)


def log_count_ratios(slots: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Logarithm of the share of each indicator in class 1 over that in class 0, with one added to each count."""
    counts = [np.bincount(np.concatenate([s for s, v in zip(slots, y, strict=True) if v == c] or [np.zeros(0, np.int32)]), minlength=1 << BITS) + 1.0 for c in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def scaled(slots: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    x = ratios[slots].astype(np.float32)
    return x / np.float32(max(np.sqrt(float(x @ x)), 1e-12))


def hinge_fit(slots: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights and constant of the hinge-loss model: one dual variable at a time, in a drawn order, within 0 and cost."""
    rows = [scaled(s, ratios) for s in slots]
    sign = np.where(y == 1, 1.0, -1.0)
    w, alpha, draw = np.zeros((1 << BITS) + 1), np.zeros(len(y)), np.random.default_rng(7)
    square = np.array([(x * x).sum() + 1.0 for x in rows])
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(y)):
            s, x = slots[i], rows[i]
            slope = sign[i] * (x @ w[s] + w[-1]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[s] += step * x
                w[-1] += step
                moved += abs(step)
                alpha[i] = new
        if moved < 1e-3 * len(y):
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the score 1 / (1 + exp(-(a * margin + b))), by Newton steps on slightly softened labels."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    p = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        h = (x * (s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (s - t) + 1e-3 * (p - np.array([1.0, 0.0])))
        p -= np.clip(step, -2, 2)
    return max(float(p[0]), 1e-3), float(p[1])


class Model:
    def __init__(self, slots: list[np.ndarray], y: np.ndarray) -> None:
        self.share = float(y.mean()) if len(y) else 0.5
        self.ratios = None
        if not 0 < self.share < 1:
            return
        left_out = np.arange(len(y)) % 5 == 4
        if min(y[left_out].sum(), (1 - y[left_out]).sum(), y[~left_out].sum(), (1 - y[~left_out]).sum()) > 0:
            some = [s for s, o in zip(slots, left_out, strict=True) if not o]
            ratios = log_count_ratios(some, y[~left_out])
            w = hinge_fit(some, y[~left_out], ratios)
            margin = np.array([scaled(s, ratios) @ w[s] + w[-1] for s, o in zip(slots, left_out, strict=True) if o])
            self.curve = logistic_curve(margin, y[left_out])
        else:
            self.curve = (2.0, 0.0)
        self.ratios = log_count_ratios(slots, y)
        w = hinge_fit(slots, y, self.ratios)
        self.ratios, self.w, self.constant = self.ratios.astype(np.float32), w[:-1].astype(np.float32), float(w[-1])

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        if self.ratios is None:
            return np.full(n, self.share)
        row, slot = indicators(data, at)
        r = self.ratios[slot].astype(np.float64)
        length = np.sqrt(np.bincount(row, r * r, n))
        margin = np.bincount(row, r * self.w[slot], n) / np.maximum(length, 1e-12) + self.constant
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, at in pieces(batch, "_text"):
            row, slot = indicators(data, at)
            cut = np.searchsorted(row, np.arange(end - first + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(slot, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_y").slice(first, end - first), lists], names=["_y", "_s"])


def _score(model: Model, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.zeros(batch.num_rows)
        for first, end, data, at in pieces(batch, text):
            score[first:end] = model.scores(data, at)
        kept = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], names=[*kept, "score", "predicted"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` labelled rows for which `learn` (a condition on _id) holds."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y")).where(learn)
    place = F.xxhash64("_id")
    n = known.count()
    drawn = known.where(F.pmod(place, F.lit(1 << 30)) < F.lit(min(1.0, 1.2 * sample / max(n, 1)) * (1 << 30))).orderBy(place, "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id")  # at most `sample` rows of two numbers
    rows = rows.groupBy("_id", "_y").agg(F.max("_text").alias("_text"))
    got = rows.orderBy(place, "_id").select("_y", "_text").mapInArrow(_slots, "_y int, _s array<int>").toArrow()
    return Model([s.values.to_numpy() for s in got.column("_s")], np.array(got.column("_y").to_pylist(), int))


def score(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text", kept_text: str | None = None) -> DataFrame:
    """The columns `keep` of every row, with score and predicted. kept_text: which of `keep` is the text, so that it is not carried twice."""
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], *([] if kept_text else [F.col(text).alias("_text")]))
    return rows.mapInArrow(partial(_score, model, kept_text or "_text"), fields(rows, ("_text",), score="double", predicted="int"))
