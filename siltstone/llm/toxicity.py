"""Toxicity: a support vector machine on Nyström features of a subsequence string kernel.

The kernel of a text with a landmark string is the logarithm of 1 plus the sum, over its words, of the fourth power of the
normalised subsequence kernel of the word with it. So it tells how often a text is hit, also where words are spelt with gaps or
inserted characters. Landmarks are the words
that labelled toxic texts have and labelled clean ones don't, and the clean words most like them. A text's kernel values are
mapped by the inverse root of the landmarks' own kernel matrix, and a linear machine (squared hinge loss) is fitted on
those features; a logistic curve through its margins gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import labelled, names, scan, tokens
from siltstone.llm.string_kernel import ORDER, Landmarks, windows
from siltstone.runtime import materialize, release, ship

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Training rows of each class at most.
PER_CLASS = 3000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 64, 24
#: Landmarks are sought among so many words of the bounded sample, those with the largest difference of rates, and four times
#: as many usual clean ones; least likelihood ratio (what a word of four toxic texts among ten times as many clean ones has).
CANDIDATES, LEAST_RATIO = 1500, 14.0
#: So many times as often as in clean texts a landmark of the toxic kind must be in toxic ones.
TOXIC_TIMES = 5
#: A landmark is less like all those before it.
ALIKE = 0.75
#: The power of the kernel that is summed: words that share little with a landmark add next to nothing, however many.
POWER = 4
#: Words of which the values are gathered at once; steps of the summed values, of which sums are exact in any order.
AT_ONCE, STEP = 30_000, 2.0**-20
#: Words whose kernel values a worker remembers.
REMEMBERED = 1_500_000

_KEPT = np.zeros(256, bool)
_KEPT[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_bytes(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows: first row, end row, bytes, word starts and ends in them, word hashes, where each row's words start.

    Words are what white space separates, with A-Z lower-cased and everything but letters (and what lies beyond ASCII)
    taken out, so ``i.d-i*o.t`` is one word; single letters that stand in a row are one word too.
    """
    buf, at = tokens.text_bytes(column)
    for first, end in tokens.blocks(buf, at):
        rows = at[first : end + 1] - at[first]
        part = tokens.FOLD[buf[at[first] : at[end]]]
        keep = _KEPT[part] | ~tokens.SPACED[part]
        rows = np.concatenate([[0], np.cumsum(keep)])[rows]
        part = part[keep]
        starts, ends = tokens.word_spans(part, tokens.SPACED, rows)
        single = ends - starts == 1
        same_row = np.searchsorted(rows, starts, "right")
        joined = single[1:] & single[:-1] & (same_row[1:] == same_row[:-1])
        if joined.any():
            drop = np.ones(len(part) + 1, bool)
            for a, b in zip(ends[:-1][joined], starts[1:][joined], strict=True):
                drop[a:b] = False
            keep = drop[:-1]
            rows = np.concatenate([[0], np.cumsum(keep)])[rows]
            part = part[keep]
            starts, ends = tokens.word_spans(part, tokens.SPACED, rows)
        yield first, end, part.tobytes(), starts, ends, tokens._hash_spans(part, starts, ends), np.searchsorted(starts, rows)


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, label): in how many texts of each label a word is."""
    seen: dict[bytes, list[int]] = {}

    def out() -> pa.RecordBatch:
        words = [(w, *n) for w, n in seen.items()]
        return pa.RecordBatch.from_arrays([pa.array([w[0] for w in words], pa.binary()), pa.array([w[1] for w in words], pa.int64()), pa.array([w[2] for w in words], pa.int64())], ["word", "clean", "toxic"])

    for batch in batches:
        label = batch.column(1).to_pylist()
        for first, end, data, starts, ends, hashes, at in word_bytes(batch.column(0)):
            for row in range(first, end):
                low, high = at[row - first], at[row - first + 1]
                for i in np.unique(hashes[low:high], return_index=True)[1] + low:
                    for w in windows(data[starts[i] : ends[i]]):
                        if len(w) >= ORDER:  # the kernel of shorter ones is 0
                            seen.setdefault(w, [0, 0])[label[row]] += 1
            if len(seen) > 500_000:
                yield out()
                seen.clear()
    if seen:
        yield out()


class Machine:
    """Landmarks, weights of their kernel values (the Nyström map and the linear machine in one), and the logistic curve."""

    def __init__(self, landmarks: list[bytes], weights: np.ndarray, bias: float, slope: float, shift: float):
        self.words, self.weights, self.bias, self.slope, self.shift = landmarks, weights, bias, slope, shift
        self._reader: Reader | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_reader": None}

    def score(self, column: pa.Array) -> np.ndarray:
        if self._reader is None:
            self._reader = Reader(Landmarks(self.words))
        margin = self._reader.texts(column) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _steps(likes: np.ndarray) -> np.ndarray:
    """Kernels of words to the power that is summed, in whole steps."""
    return np.rint(likes**POWER / np.float32(STEP))


class Reader:
    """Kernel values of texts with landmarks; values of words seen before are remembered, in bounded memory."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.values = np.zeros((1, len(self.landmarks.words)), np.float32)  # row 0: like no landmark

    def _places(self, hashes: np.ndarray, spans: list[bytes]) -> np.ndarray:
        """Row of ``values`` for each of some distinct sorted hashes; ``spans``: their words."""
        where = np.searchsorted(self.known, hashes)
        found = where < len(self.known)
        found[found] = self.known[where[found]] == hashes[found]
        new = np.flatnonzero(~found)
        if len(new):
            if len(self.known) + len(new) > REMEMBERED:
                self._forget()
                return self._places(hashes, spans) if len(hashes) <= REMEMBERED else self._fresh(spans)
            parts = [windows(spans[i]) for i in new]
            flat = self.landmarks.similar([w for p in parts for w in p])
            likes = _steps(np.maximum.reduceat(flat, np.cumsum([0, *[len(p) for p in parts[:-1]]]), axis=0))
            some = likes.any(axis=1)
            place = np.zeros(len(new), np.int32)
            place[some] = len(self.values) + np.arange(int(some.sum()), dtype=np.int32)
            self.values = np.concatenate([self.values, likes[some]])
            self.known = np.insert(self.known, where[new], hashes[new])
            self.place = np.insert(self.place, where[new], place)
            where = np.searchsorted(self.known, hashes)
        return self.place[where]

    def _fresh(self, spans: list[bytes]) -> np.ndarray:
        self.values = np.zeros((1, len(self.landmarks.words)), np.float32)
        out = np.zeros(len(spans), np.int32)
        for i, word in enumerate(spans):
            likes = _steps(self.landmarks.similar(windows(word)).max(axis=0))
            if likes.any():
                out[i] = len(self.values)
                self.values = np.concatenate([self.values, likes[None]])
        return out

    def texts(self, column: pa.Array) -> np.ndarray:
        total = np.zeros((len(column), len(self.landmarks.words)))
        for first, _end, data, starts, ends, hashes, at in word_bytes(column):
            if not len(hashes):
                continue
            distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            place = self._places(distinct, [data[starts[i] : ends[i]] for i in index])[inverse]
            hot = np.flatnonzero(place)
            rows = np.searchsorted(at, hot, "right") - 1 + first
            for start in range(0, len(hot), AT_ONCE):
                row, edge = np.unique(rows[start : start + AT_ONCE], return_index=True)
                total[row] += np.add.reduceat(self.values[place[hot[start : start + AT_ONCE]]], edge, axis=0, dtype=np.float64)
        return np.log1p(total * STEP).astype(np.float32)


def choose_landmarks(counts: list[tuple[bytes, int, int]], clean_texts: int, toxic_texts: int, *, toxic: int = TOXIC_LANDMARKS, clean: int = CLEAN_LANDMARKS) -> list[bytes]:
    """From (word, clean texts, toxic texts): ``toxic`` toxic words by likelihood ratio, each unlike those before, and ``clean`` clean
    words like them."""
    bad, good = [], []
    for word, c, t in counts:
        rate = (c + t) / max(1, clean_texts + toxic_texts)
        expected = rate * toxic_texts, rate * clean_texts
        ratio = 2 * sum(o * np.log(o / e) for o, e in zip((t, c), expected, strict=True) if o and e)
        in_toxic, in_clean = t / max(1, toxic_texts), c / max(1, clean_texts)
        if in_toxic > TOXIC_TIMES * in_clean and ratio >= LEAST_RATIO:
            bad.append((-ratio, word))
        elif in_toxic <= 1.5 * in_clean:
            good.append((-c, word))
    bad.sort()
    good.sort()
    chosen: list[bytes] = []
    for _, word in bad:
        if len(chosen) == toxic:
            break
        if not chosen or Landmarks(chosen).similar([word]).max() < ALIKE:
            chosen.append(word)
    if not chosen:
        return []
    pool = [w for _, w in good]
    likeness = Landmarks(chosen).similar(pool).max(axis=1) if pool else np.zeros(0)
    return chosen + [pool[i] for i in np.argsort(-likeness, kind="stable")[:clean] if likeness[i] > 0]


def fit(values: np.ndarray, labels: np.ndarray, landmarks: list[bytes], prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Machine:
    """The machine from texts' kernel values with the landmarks."""
    own = Landmarks(landmarks).similar(landmarks).astype(np.float64)
    levels, axes = np.linalg.eigh(((own + own.T) / 2) ** POWER + 1e-2 * np.eye(len(own)))
    root = axes @ np.diag(1 / np.sqrt(np.maximum(levels, 1e-2))) @ axes.T
    x = values.astype(np.float64) @ root
    sign = np.where(labels == 1, 1.0, -1.0)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        slack = np.maximum(0, 1 - sign * (x @ w + b))
        pull = -2 * weight * sign * slack
        grad = np.append(x.T @ pull + decay * w, pull.sum())
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    margin = x @ w + b
    natural = np.where(labels == 1, prior / max(1, (labels == 1).sum()), (1 - prior) / max(1, (labels == 0).sum()))
    slope, shift = _logistic(margin, labels, natural)
    return Machine(landmarks, root @ w, float(b), slope, shift)


def _logistic(margin: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve through the margins, by Newton steps."""
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - labels)) + 1e-3 * np.array([theta[0] - 2.0, theta[1]])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(theta[0], 0.1)), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS, candidates: int = CANDIDATES, id_col: str = "doc_id", text_col: str = "text") -> Machine | float:
    """A machine fitted on a bounded sample of the training folds, in one task of an executor. With labels of one class only, without
    labels, or where no word tells the classes apart, the share of class 1 (0.0 without labels) is the score of every text."""
    rows, counts = labelled.sample(docs, labels, label, folds=folds, held_out=held_out, per_class=per_class, id_col=id_col, text_col=text_col)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return prior
    ship(docs.sparkSession)
    words = rows.select("text", "label").mapInArrow(_document_words, "word binary, clean long, toxic long")
    words = materialize(words.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-words")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    many = words.orderBy(F.desc(F.col("toxic") / sizes.get(1, 1) - F.col("clean") / sizes.get(0, 1)), "word").limit(candidates)
    usual = words.orderBy(F.desc("clean"), "word").limit(4 * candidates)
    found = {bytes(r["word"]): (r["clean"], r["toxic"]) for r in [*many.collect(), *usual.collect()]}
    release(words)
    landmarks = choose_landmarks([(w, *n) for w, n in sorted(found.items())], sizes.get(0, 0), sizes.get(1, 0))
    if not landmarks:
        return prior

    def learn(table: pa.Table) -> Machine:
        keys = sorted(zip(table.column("values").to_pylist(), table.column("label").to_pylist(), strict=True))  # the same order in every run
        return fit(np.stack([np.frombuffer(k, np.float32) for k, _ in keys]), np.array([y for _, y in keys]), landmarks, prior)

    valued = scan.add_columns(rows, ["text"], _value_maker(landmarks), "values binary", drop=("text",))
    return labelled.fit_in_task(valued, learn, ["values", "label"])


def _value_maker(landmarks: list[bytes]):
    def make(column: pa.Array) -> list[pa.Array]:
        return [pa.array([v.tobytes() for v in Reader(Landmarks(landmarks)).texts(column)], pa.binary())]

    return make


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, **training) -> DataFrame:
    """``docs`` with toxicity_score (0 to 1) added, by a machine trained on the labelled rows outside the held-out fold.

    Only the text is scored: labels, language, source and id are not inputs. Null and empty texts are like no landmark and get
    the score of such. Rows with null ids are scored and never learned from. Repeated rows get equal scores. A column called toxicity_score is replaced. Empty tables give an
    empty result.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **training)
    if isinstance(model, float):
        return names.without(docs, "toxicity_score", *([] if keep_text else [text_col])).withColumn("toxicity_score", F.lit(model))
    return scan.add_columns(docs, [text_col], lambda c: [pa.array(model.score(c).astype(np.float64), pa.float64())], "toxicity_score double", drop=() if keep_text else (text_col,))
