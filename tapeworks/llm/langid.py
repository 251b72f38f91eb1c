"""Language identification by error-correcting output codes (operator 3).

Each language has a codeword; one linear classifier on hashed byte n-grams predicts each bit; a text goes to the codeword
with the smallest loss-weighted distance, where a bit counts for a language as much as its classifier was right about
that language in training. The two nearest codewords too close to each other flag the text as ambiguous.

Training reads about SAMPLE rows, drawn by a hash of id and text, an equal number for each language and one at least. Prediction reads
every whole text. Nothing but the text enters a prediction.

Edge cases: a NULL text, or one without a letter, is `und` with score 0; with no language to learn every text is `und`;
with one, it gets every text with a letter; rows with NULL language or NULL id are not learned from but predicted;
a NULL id is not held out; repeated rows are each returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import LOWER, fields, padded, pieces

SAMPLE = 2000  # rows learned from, all languages together
WIDTH = 1 << 12  # hashed n-grams of one to three bytes
CLOSE = 0.05  # a score of the nearest codeword less than this above that of the second is ambiguous
_LETTERS = np.where(np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)]), LOWER, 32).astype(np.uint8)


def ngram_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Root of the share of each hashed n-gram in each text: rows of length one. Bytes that are no letters count as one space."""
    flat, starts = padded(data, at, 1, 2, 0x20)
    flat = _LETTERS[flat]
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32)
    keep[starts[1:-1]] = True  # the first space of each text
    row = np.repeat(np.arange(len(at) - 1), np.diff(starts))[keep]
    flat = flat[keep].astype(np.uint32)
    out = np.zeros((len(at) - 1) * WIDTH)
    gram = np.zeros(len(flat), np.uint32)
    for n in range(3):
        gram = (gram[: len(flat) - n] << np.uint32(8)) | flat[n:]
        slot = ((gram + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(20)
        inside = row[: len(slot)] == row[n:]
        out += np.bincount(row[: len(slot)][inside] * WIDTH + slot[inside], minlength=len(out))
    out = out.reshape(-1, WIDTH)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)).astype(np.float32)


def code_matrix(k: int) -> np.ndarray:
    """k codewords of -1 and 1: all splits of the languages for few of them, else the best of many drawn codes."""
    if k < 2:
        return np.ones((k, 0), np.int8)
    if k <= 6:
        bits = np.arange(1, 1 << (k - 1))
        return np.array([np.ones(len(bits)) if i == 0 else 1 - 2 * ((bits >> (i - 1)) & 1) for i in range(k)], np.int8)
    draw, best = np.random.default_rng(k), None
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (k, int(np.ceil(10 * np.log2(k)))))
        dot = code.astype(np.float32) @ code.T.astype(np.float32)
        far = (code.shape[1] - dot[~np.eye(k, dtype=bool)].max()) / 2
        if best is None or far > best[0]:
            best = (far, code)
    return best[1]


def fit_bits(x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Weights (inputs and one constant, bits) of logistic classifiers for labels of -1 and 1, by accelerated gradient steps."""
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    ahead, rate = w.copy(), np.float32(2.0)  # rows with the constant have length at most root 2, so the curvature is at most a half
    for t in range(steps):
        g = -(y / (1 + np.exp(np.clip(y * (x @ ahead[:-1] + ahead[-1]), -30, 30)))).astype(np.float32)
        new = ahead - rate * (np.vstack([x.T @ g, g.sum(0)]) / np.float32(len(x)) + np.float32(ridge) * ahead)
        ahead = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


class Codes:
    """A fitted model: languages, codewords, classifiers of the bits, and the weight of each bit for each language."""

    def __init__(self, names: list[str], x: np.ndarray, label: np.ndarray) -> None:
        self.names, self.code = names, code_matrix(len(names))
        self.w = fit_bits(x, self.code[label].astype(np.float32)) if len(names) > 1 else None
        if self.w is not None:
            right = np.sign(self.margins(x)) == self.code[label]
            weight = np.array([right[label == i].mean(0) + 1e-6 for i in range(len(names))])
            self.weight = weight / weight.sum(1, keepdims=True)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score and that of the second."""
        if self.w is None:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x))
        f = self.margins(x)
        loss = np.stack([(self.weight[i] * np.logaddexp(0, -3 * self.code[i] * f)).sum(1) for i in range(len(self.names))], 1)
        near = np.exp(4 * (loss.min(1, keepdims=True) - loss))
        near /= near.sum(1, keepdims=True)
        order = np.argsort(-near, 1, kind="stable")
        rows = np.arange(len(x))
        return order[:, 0], near[rows, order[:, 0]], near[rows, order[:, 1]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, at in pieces(batch, "_text"):
            x = ngram_rows(data, at)
            yield pa.RecordBatch.from_arrays([batch.column("_lang").slice(first, end - first), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["_lang", "_x"])


def _predict(model: Codes, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best, score, second = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for first, end, data, at in pieces(batch, text):
            best[first:end], score[first:end], second[first:end] = model.decode(ngram_rows(data, at))
        known = np.asarray(batch.column("_letter").fill_null(False)) & bool(model.names)
        names = np.array(model.names, object)
        lang = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
        score = np.where(known, score, 0.0)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in batch.schema.names if c not in ("_text", "_letter")], pa.array(lang, pa.string()), pa.array(score), pa.array(known & (score - second < CLOSE))],
            names=[*[c for c in batch.schema.names if c not in ("_text", "_letter")], "lang_pred", "score", "ambiguous"])


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Codes:
    """Learn from at most `sample` of the rows where `learn` holds, whose language is not NULL and which hold a letter.

    Every language there is learned; one that the draw left out, and each of more than `sample` languages, adds a row.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & has_letter(text))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang).alias("_l")).agg(F.count(F.lit(1)).alias("_n")).collect()}
    names = sorted(counts)
    if not names:
        return Codes([], np.zeros((0, WIDTH), np.float32), np.zeros(0, int))
    each = max(1, sample // len(names))
    rate = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, each / counts[n]))])
    place = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), place.alias("_at"), (place / rate[F.col(lang)]).alias("_in")).where("_in < 1")
    drawn = drawn.orderBy("_in", "_text").limit(sample)
    got = drawn.select("_lang", "_text").mapInArrow(_rows, "_lang string, _x binary").toArrow()
    left_out = sorted(set(names) - set(got.column("_lang").to_pylist()))
    if left_out:
        one = known.where(F.col(lang).isin(left_out)).groupBy(F.col(lang).alias("_lang")).agg(F.min(F.struct(place.alias("_at"), F.col(text).alias("_text"))).alias("_first"))
        got = pa.concat_tables([got, one.select("_lang", F.col("_first._text").alias("_text")).mapInArrow(_rows, "_lang string, _x binary").toArrow()])
    x = np.stack([np.frombuffer(v.as_buffer(), np.float16).astype(np.float32) for v in got.column("_x")]) if got.num_rows else np.zeros((0, WIDTH), np.float32)
    place_of = {n: i for i, n in enumerate(names)}
    return Codes(names, x, np.array([place_of[v] for v in got.column("_lang").to_pylist()]))


def predict(docs: DataFrame, model: Codes, keep: dict[str, Column], text: str = "text", kept_text: str | None = None) -> DataFrame:
    """The columns `keep` of every row, with lang_pred, score and ambiguous. kept_text: which of `keep` is the text, so that it is not carried twice."""
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], *([] if kept_text else [F.col(text).alias("_text")]), has_letter(text).alias("_letter"))
    return rows.mapInArrow(partial(_predict, model, kept_text or "_text"), fields(rows, ("_text", "_letter"), lang_pred="string", score="double", ambiguous="boolean"))
