"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Metadata are columns that the caller names (none by default), each value hashed to one of a few features. The registered query
may not use language, source or id, so the recorded length ``n_chars`` is its only one.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise sum is taken in linear time as
1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from siltstone.llm import labelled, names, scan, tokens

BUCKETS, META, RANK = 2048, 64, 8
#: Training rows of each class at most.
PER_CLASS = 2000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Texts that are turned into dense feature rows at once.
ROWS = 256
QUANTILES = np.array([0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98])

_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _class_table() -> np.ndarray:
    chars = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!", "?", "%$&*#@^~", "|<>{}[]()/\\=+_-", "\"'`", "\n", " \t\r"]
    table = np.zeros((256, len(chars) + 1), np.float32)
    for i, c in enumerate(chars):
        table[[*c.encode()], i] = 1
    table[128:, -1] = 1
    return table


_CLASSES = _class_table()
STATISTICS = _CLASSES.shape[1] + 10


def describe(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: hashed words (BUCKETS columns; roots of relative frequencies), and structure statistics."""
    rows = len(column)
    words, stats = np.zeros((rows, BUCKETS), np.float32), np.zeros((rows, STATISTICS), np.float32)
    buf, at = tokens.text_bytes(column)
    size = np.diff(at).astype(np.float32)
    for i in range(rows):
        stats[i, : _CLASSES.shape[1]] = np.bincount(buf[at[i] : at[i + 1]], minlength=256) @ _CLASSES
    n_words, distinct, most = np.zeros(rows, np.float32), np.zeros(rows, np.float32), np.zeros(rows, np.float32)
    for first, end, hashes, starts in tokens.hashed_words(column, tokens.SPACED):
        for i in range(first, end):
            own = hashes[starts[i - first] : starts[i - first + 1]]
            if len(own):
                words[i] = np.bincount((own & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                counts = np.unique(own, return_counts=True)[1]
                n_words[i], distinct[i], most[i] = len(own), len(counts), counts.max()
    lines, repeated = np.zeros(rows, np.float32), np.zeros(rows, np.float32)
    for first, end, hashes, starts in tokens.hashed_words(column, _LINE):
        for i in range(first, end):
            own = hashes[starts[i - first] : starts[i - first + 1]]
            lines[i], repeated[i] = len(own), len(own) - len(np.unique(own))
    base = np.maximum(n_words, 1)
    upper, lower = stats[:, 0].copy(), stats[:, 1].copy()
    k = _CLASSES.shape[1]
    stats[:, :k] /= np.maximum(size, 1)[:, None]
    stats[:, k:] = np.stack([np.log1p(size), np.log1p(n_words), size / base, distinct / base, most / base, upper / np.maximum(upper + lower, 1), np.log1p(lines), base / np.maximum(lines, 1) / 100, repeated / np.maximum(lines, 1), distinct / np.sqrt(base)], axis=1)
    return np.sqrt(words / base[:, None]), stats


def metadata_bins(docs: DataFrame, metadata: tuple[str, ...]) -> Column:
    """For each row the feature number of each metadata column: a hash of its name and value, a number being rounded to its binary
    logarithm. Null is a value of its own."""
    bins = []
    for name in metadata:
        value, kind = names.col(name), docs.select(names.col(name)).schema[0].dataType
        if isinstance(kind, NumericType):
            value = F.signum(value.cast("double")) * F.floor(F.log2(1 + F.abs(value.cast("double"))))
        bins.append(F.pmod(F.xxhash64(F.lit(name), F.coalesce(value.cast("string"), F.lit("null"))), F.lit(META)).cast("int"))
    return F.array(*bins).cast("array<int>")


def one_hot(bins: pa.Array) -> np.ndarray:
    """Rows of META columns, with 0.5 where a metadata feature is."""
    out = np.zeros((len(bins), META), np.float32)
    for i, own in enumerate(bins.to_pylist()):
        out[i, own] = 0.5
    return out


@dataclass
class Machine:
    mean: np.ndarray
    deviation: np.ndarray
    cuts: np.ndarray  # statistics x quantiles
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def rows(self, words: np.ndarray, stats: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Feature rows: hashed words, metadata, standardised statistics, and which quantile range each statistic is in."""
        scaled = np.clip((stats - self.mean) / self.deviation, -4, 4) / 4
        ranges = (stats[:, :, None] > self.cuts[None]).sum(axis=2)
        one_hot = (ranges[:, :, None] == np.arange(self.cuts.shape[1] + 1)).reshape(len(stats), -1) * 0.5
        return np.concatenate([words, meta, scaled, one_hot], axis=1).astype(np.float32)

    def decide(self, x: np.ndarray) -> np.ndarray:
        mixed = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * (mixed**2 - (x**2) @ (self.factors**2)).sum(axis=1)

    def score(self, column: pa.Array, bins: pa.Array) -> np.ndarray:
        return _sigmoid(self.decide(self.rows(*describe(column), one_hot(bins)))).astype(np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(words: np.ndarray, stats: np.ndarray, meta: np.ndarray, labels: np.ndarray, prior: float, *, rank: int = RANK, steps: int = 200, rate: float = 0.05, decay: float = 2e-3, seed: int = 3) -> Machine:
    """Logistic loss by Adam over the whole sample; the classes are weighted to their share ``prior`` (of class 1) in training."""
    cuts = np.quantile(stats, QUANTILES, axis=0).T
    model = Machine(stats.mean(axis=0), stats.std(axis=0) + 1e-6, cuts, 0.0, np.zeros(0), np.zeros(0))
    x = model.rows(words, stats, meta)
    ones = max(1, int(labels.sum()))
    weight = np.where(labels == 1, prior / ones, (1 - prior) / max(1, len(labels) - ones)).astype(np.float32)
    rng = np.random.default_rng(seed)
    at = [np.zeros(1, np.float32), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.01, (x.shape[1], rank)).astype(np.float32)]
    at[0][0] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    moment, square = [np.zeros_like(a) for a in at], [np.zeros_like(a) for a in at]
    x2 = x**2
    for step in range(1, steps + 1):
        bias, w, v = at
        mixed = x @ v
        z = bias[0] + x @ w + 0.5 * (mixed**2 - x2 @ (v**2)).sum(axis=1)
        slope = ((_sigmoid(z) - labels) * weight).astype(np.float32)
        grads = [np.array([slope.sum()], np.float32), x.T @ slope + decay * w / 10, x.T @ (slope[:, None] * mixed) - v * (x2.T @ slope)[:, None] + decay * v / 10]
        for k, g in enumerate(grads):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            at[k] = at[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
    model.bias, model.weights, model.factors = float(at[0][0]), at[1], at[2]
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> Machine | float:
    """A machine fitted on a bounded sample of the training folds, in one task of an executor; with one class only or none, the
    share of class 1 (0.5 without labels) as a constant score."""
    rows, counts = labelled.sample(docs, labels, label, folds=folds, held_out=held_out, per_class=per_class, id_col=id_col, text_col=text_col, others=metadata)
    total = sum(counts.values())
    if len(counts) < 2:
        return counts.get(1, 0) / total if total else 0.5
    prior = counts[1] / total

    def make(column: pa.Array) -> list[pa.Array]:
        words, stats = describe(column)
        return [pa.array([w.astype(np.float16).tobytes() for w in words], pa.binary()), pa.array([s.astype(np.float32).tobytes() for s in stats], pa.binary())]

    def learn(table: pa.Table) -> Machine | float:
        known = table.column("label").to_numpy()
        if len(np.unique(known)) < 2:
            return prior
        keys = list(zip(table.column("stats").to_pylist(), table.column("words").to_pylist(), known.tolist(), strict=True))
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))  # the same order in every run
        stats = np.stack([np.frombuffer(keys[i][0], np.float32) for i in order])
        words = np.stack([np.frombuffer(keys[i][1], np.float16) for i in order]).astype(np.float32)
        del keys
        return fit(words, stats, one_hot(table.column("bins").combine_chunks())[order], known[order].astype(np.float32), prior)

    described = scan.add_columns(rows.withColumn("bins", metadata_bins(rows, metadata)), ["text"], make, "words binary, stats binary", drop=("text",), rows=ROWS)
    made = labelled.fit_in_task(described, learn, ["words", "stats", "bins", "label"])
    return prior if made is None else made


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, metadata: tuple[str, ...] = (), **training) -> DataFrame:
    """``docs`` with quality_score (0 to 1) added, by a machine trained on the labelled rows outside the held-out fold.

    Only the text and the columns named in ``metadata`` are scored: labels and id are not inputs. Null texts are empty; an empty
    text has the statistics of one and gets a score too. Rows with null ids are scored and never learned from. Repeated
    rows get equal scores. Without labels of both classes the score is a constant. A column called quality_score is replaced.
    Empty tables give an empty result.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, metadata=metadata, **training)
    if isinstance(model, float):
        return names.without(docs, "quality_score", *([] if keep_text else [text_col])).withColumn("quality_score", F.lit(model))
    return scan.add_columns(docs, [text_col, metadata_bins(docs, metadata)], lambda c, bins: [pa.array(model.score(c, bins), pa.float64())], "quality_score double", drop=() if keep_text else (text_col,), rows=ROWS)
