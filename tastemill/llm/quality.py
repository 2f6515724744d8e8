"""Operator 8: document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad; its features are its own and those of the lines
before and after it, and neighbouring labels are tied by a transition weight. A document's
score is the length-weighted mean of its lines' forward-backward marginals, calibrated by
a logistic curve. The field is fitted on a bounded sample of labelled documents whose
lines inherit the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tastemill.llm._jobs import every_column
from tastemill.llm._text import Words, pieces, span_hashes

OWN = 14  # features of a line itself, the constant included
FEATURES = 3 * (OWN - 1) + 3
SCORES = "doc_id long, score double"

_UPPER, _LOWER, _DIGIT, _STOP, _MARK, _BANG, _BAR, _SIGN = range(8)
_KIND = np.full(256, _SIGN, dtype=np.uint8)
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("a") : ord("z") + 1] = _LOWER
_KIND[0x80:] = _LOWER  # letters outside ASCII count as letters of text
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[ord(c) for c in ".,;:?"]] = _STOP
_KIND[[ord(c) for c in "'\"-()"]] = _MARK
_KIND[ord("!")] = _BANG
_KIND[[ord("|"), ord("\t")]] = _BAR
_KIND[[0x20, 0x0A, 0x0B, 0x0C, 0x0D]] = 255


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features, bytes, lines before each row) of the lines of some texts; blank lines are none."""
    words = Words(column)
    buf, offsets = words.buf, words.offsets
    n = len(buf)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    cut[np.flatnonzero(buf == 0x0A) + 1] = True
    starts = np.flatnonzero(cut[:n]) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)[: len(starts)]
    of_word = np.searchsorted(starts, words.starts, "right") - 1
    per_line = np.bincount(of_word, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    full = per_line > 0
    starts, ends = starts[full], ends[full]
    number = np.cumsum(full) - 1
    of_word = number[of_word] if len(of_word) else of_word
    m = len(starts)
    rows = np.searchsorted(starts, offsets)
    x = np.zeros((m, OWN), dtype=np.float32)
    if not m:
        return x, np.zeros(0), rows
    kind = _KIND[buf]

    def count(which: np.ndarray) -> np.ndarray:
        """How many of some bytes each line has."""
        sums = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(which, out=sums[1:])
        return sums[ends] - sums[starts]

    solid = np.maximum(count(kind != 255), 1)
    letters = np.maximum(count(kind <= _LOWER), 1)
    n_words = np.bincount(of_word, minlength=m)
    length = (words.ends - words.starts).astype(np.float64)
    hashed = words.hashes()
    order = np.lexsort((hashed, of_word))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    line_hash = span_hashes(buf, starts, ends)
    of_row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    by = np.lexsort((np.arange(m), line_hash, of_row))
    again = np.zeros(m)
    again[by[1:]] = (line_hash[by][1:] == line_hash[by][:-1]) & (of_row[by][1:] == of_row[by][:-1])
    x[:, 0] = 1
    x[:, 1] = np.log1p(ends - starts) / 5
    x[:, 2] = np.log1p(n_words) / 5
    x[:, 3] = np.minimum(np.bincount(of_word, length, minlength=m) / n_words / 10, 3)
    x[:, 4] = np.bincount(of_word, length <= 3, minlength=m) / n_words
    x[:, 5] = np.bincount(of_word, length >= 15, minlength=m) / n_words
    x[:, 6] = count(kind == _UPPER) / letters
    x[:, 7] = count(kind == _DIGIT) / solid
    x[:, 8] = count(kind == _SIGN) / solid
    x[:, 9] = np.minimum(count(kind == _BANG) / n_words, 2)
    x[:, 10] = np.minimum(count(kind == _BAR) / n_words, 2)
    x[:, 11] = np.minimum(count(kind == _STOP) / n_words, 2)
    x[:, 12] = np.bincount(of_word[order], new, minlength=m) / n_words
    x[:, 13] = again
    return x, (ends - starts).astype(np.float64), rows


def _edges(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines that have one before them in their row, and lines that have one after them."""
    inner = np.ones(int(rows[-1]), dtype=bool)
    inner[rows[:-1][np.diff(rows) > 0]] = False
    before = np.flatnonzero(inner)
    return before, before - 1


def with_neighbours(own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All features of lines: their own, and those of the lines before and after."""
    x = np.zeros((len(own), FEATURES), dtype=np.float64)
    x[:, :OWN] = own
    before, after = _edges(rows)
    x[before, OWN : 2 * OWN - 1] = own[before - 1, 1:]
    x[before, -2] = 1
    x[after, 2 * OWN - 1 : 3 * OWN - 2] = own[after + 1, 1:]
    x[after, -1] = 1
    return x


def logits(own: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """with_neighbours(own, rows) @ weights, without that matrix."""
    out = own @ weights[:OWN]
    before, after = _edges(rows)
    out[before] += (own[:, 1:] @ weights[OWN : 2 * OWN - 1])[before - 1] + weights[-2]
    out[after] += (own[:, 1:] @ weights[2 * OWN - 1 : 3 * OWN - 2])[after + 1] + weights[-1]
    return out


@dataclass
class Field:
    """Weights of the label good against bad, the log transition matrix, the calibration curve and the prior."""

    weights: np.ndarray
    transition: np.ndarray
    slope: float
    shift: float
    prior: float

    def scores(self, own: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
        good = np.clip(self.mean(logits(own, rows, self.weights), size, rows), 1e-6, 1 - 1e-6)
        out = 1 / (1 + np.exp(-(self.slope * np.log(good / (1 - good)) + self.shift)))
        out[np.diff(rows) == 0] = self.prior
        return out

    def mean(self, logit: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the marginals of each row's lines."""
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[rows])
        total = sums(size)
        return sums(forward_backward(logit, rows, self.transition)[0] * size) / np.where(total > 0, total, 1)


def forward_backward(logit: np.ndarray, rows: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected transitions (2 x 2) of every row; all rows advance together."""
    m, n_rows = len(logit), len(rows) - 1
    lines = np.diff(rows)
    order = np.argsort(-lines, kind="stable")
    first, lines = rows[:-1][order], lines[order]
    near = np.exp(transition)
    half = np.clip(logit, -40, 40) / 2
    psi = np.stack([np.exp(-half), np.exp(half)], axis=1)
    alpha, beta = np.ones((m, 2)), np.ones((m, 2))
    steps = int(lines[0]) if n_rows else 0
    active = [int(np.searchsorted(-lines, -t, "left")) for t in range(steps + 1)]
    for t in range(steps):
        at = first[: active[t]] + t
        a = psi[at] if t == 0 else psi[at] * (alpha[at - 1] @ near)
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((n_rows, 2, 2))
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        ahead = psi[at + 1] * beta[at + 1]
        joint = alpha[at][:, :, None] * near * ahead[:, None, :]
        pairs[order[: active[t + 1]]] += joint / joint.sum(axis=(1, 2), keepdims=True)
        b = ahead @ near.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(axis=1), pairs


def fit_field(x: np.ndarray, size: np.ndarray, rows: np.ndarray, label: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> Field:
    """Maximum likelihood by gradient steps (Adam); each document weighs the same."""
    prior = float((label.sum() + 1) / (len(label) + 2)) if len(label) else 0.5
    empty = Field(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, float(np.log(prior / (1 - prior))), prior)
    if len(set(label.tolist())) < 2 or not len(x):
        return empty
    lines = np.diff(rows)
    y = np.repeat(label, lines).astype(np.float64)
    weight = np.repeat(1 / np.maximum(lines, 1), lines)
    seen = np.zeros((len(label), 2, 2))
    seen[np.arange(len(label)), label, label] = np.maximum(lines - 1, 0)
    theta = np.zeros(FEATURES + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, pairs = forward_backward(x @ theta[:FEATURES], rows, theta[FEATURES:].reshape(2, 2))
        grad = np.concatenate([x.T @ (weight * (y - p)), ((seen - pairs) / np.maximum(lines, 1)[:, None, None]).sum(axis=0).ravel()]) / len(label) - penalty * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        theta[FEATURES:] = np.clip(theta[FEATURES:], -3, 3)
    field = Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), 1.0, 0.0, prior)
    mean = np.clip(field.mean(x @ field.weights, size, rows), 1e-6, 1 - 1e-6)[lines > 0]
    z, t = np.log(mean / (1 - mean)), label[lines > 0]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one number
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((t - p) * z).sum() - 1e-2 * (a - 1), (t - p).sum()])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    field.slope, field.shift = float(max(a, 1e-3)), float(b)
    return field


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, most_lines: int = 256) -> Field:
    """Fit on at most ``sample`` labelled documents of at most ``most_lines`` lines each.

    The sample is the labelled ids with the smallest hashes. Labels other than 0 and 1 and
    null ids are left out; of an id's labels the smallest counts, and of rows that repeat an
    id that with the smallest features. Without both labels, every score is the share of good ones.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "label")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            own, size, rows = line_features(piece.column(1))
            keep = [i for i in range(piece.num_rows) if rows[i + 1] - rows[i] <= most_lines]
            parts = [(piece.column(0)[i].as_py(), piece.column(2)[i].as_py(), own[rows[i] : rows[i + 1]].tobytes(), size[rows[i] : rows[i + 1]].astype(np.float32).tobytes()) for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in parts], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.binary(), pa.binary()])], names=["id", "label", "x", "size"])

    seen = sorted(texts.mapInArrow(task, "id long, label int, x binary, size binary").collect(), key=lambda r: (r.id, bytes(r.x)))
    found = [r for i, r in enumerate(seen) if i == 0 or seen[i - 1].id != r.id]
    size = [np.frombuffer(r["size"], np.float32) for r in found]
    rows = np.concatenate([[0], np.cumsum([len(s) for s in size])]).astype(np.int64)
    own = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, OWN) for r in found] or [np.zeros((0, OWN))])
    return fit_field(with_neighbours(own, rows), np.concatenate(size or [np.zeros(0)]).astype(np.float64), rows, np.array([r["label"] for r in found], dtype=np.int64))


def quality_scores(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) of each row: 0 to 1, higher is better.

    Null, empty or blank text: the share of good documents in the training sample. Null
    doc_id and repeated rows: scored row by row. Empty table: no rows. Only the text
    enters the score; other columns are ignored.
    """
    return _scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), field, ["doc_id"])


def _scored(df: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of a frame with a column text, and score."""
    shared = df.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers
    text = df.columns.index("text")
    schema = StructType([*(df.schema[c] for c in keep), StructField("score", DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            score = pa.array(shared.value.scores(*line_features(piece.column(text))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in keep), score], names=[*keep, "score"])

    return df.mapInArrow(task, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "quality"))
    return quality_scores(docs, field).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that score 0.5 or more under a field fitted on ``labels``.

    Null, empty and blank texts have the share of good documents as their score. Null doc_id
    and repeated rows are judged row by row. Empty table: no rows; no labels: all rows stay.
    Columns may have any names.
    """
    field = train(docs.select("doc_id", "text"), labels.where(~held_out()).select("doc_id", "quality"))
    narrow = docs.select(every_column(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return _scored(narrow, field, ["row"]).where("score >= 0.5").select("row.*")
