"""The gap-weighted subsequence kernel of Lodhi et al., for many pairs of short byte strings at once.

k_p(s, t) sums, over all common subsequences of ``p`` characters, ``decay`` to the power of the stretches that they span in
both strings. Inserted characters and gaps lower it gently; the normalised kernel is 1 for equal strings.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

ORDER, DECAY = 3, 0.7
#: Longest string taken whole; longer ones are cut into overlapping windows by ``windows``.
LONGEST = 20
#: Subsequences that are looked up at once.
CELLS = 200_000


def windows(word: bytes) -> list[bytes]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words as rows of bytes (0 beyond the end), and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.frombuffer(b"".join(w.ljust(LONGEST, b"\0") for w in words), np.uint8).reshape(len(words), LONGEST)
    return out, lengths


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """k_order of each pair of rows of ``s`` and ``t`` (padded)."""
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    # first[i][b]: K'_i(s so far, t[:b]); one more character of s updates all of them.
    first = np.zeros((order, lt + 1, n), np.float32)
    first[0] = 1
    total = np.zeros(n, np.float32)
    square = np.float32(decay * decay)
    live = t != 0
    for a in range(ls):
        char = s[:, a]
        if not char.any():
            break
        same = ((t == char[:, None]) & live & (char != 0)[:, None]).T.astype(np.float32)
        total += square * (same * first[order - 1, :lt]).sum(axis=0)
        for i in range(order - 1, 0, -1):
            run = np.zeros(n, np.float32)  # K''_i along t
            for b in range(lt):
                run = decay * run + square * same[b] * first[i - 1, b]
                first[i, b + 1] = decay * first[i, b + 1] + run
    return total


@lru_cache(LONGEST + 1)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All places i < j < k below n, and decay to the power of the stretch from i to k."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1.0)).astype(np.float32)


class Landmarks:
    """Normalised kernel values of words with fixed strings, exactly.

    A kernel is the product of two feature rows, which have a feature for each subsequence of ``ORDER`` characters. The
    landmarks' features are a table; a word's own are looked up there, so the work grows with the features that
    it shares with some landmark.
    """

    def __init__(self, words: list[bytes]):
        self.words = words
        self.letters = np.zeros(256, np.int64)  # 0: in no landmark
        known = sorted(set(b"".join(words)))
        self.letters[known] = np.arange(1, len(known) + 1)
        self.base = len(known) + 1
        values: dict[int, np.ndarray] = {}
        for j, word in enumerate(words):
            at, weight = _triples(len(word))
            for code, w in zip(self._codes(np.frombuffer(word, np.uint8)[None], at)[0].tolist(), weight, strict=True):
                values.setdefault(code, np.zeros(len(words), np.float32))[j] += w
        self.place = np.full(self.base**ORDER, -1, np.int32)
        self.place[list(values)] = np.arange(len(values))
        self.features = np.array(list(values.values()), np.float32).reshape(-1, len(words))
        self.own = (self.features**2).sum(axis=0)

    def _codes(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        letters = self.letters[rows]
        codes = letters[:, at[:, 0]]
        for k in range(1, ORDER):
            codes = codes * self.base + letters[:, at[:, k]]
        return codes

    def similar(self, words: list[bytes]) -> np.ndarray:
        """words x landmarks, in [0, 1]; words of fewer than ``ORDER`` characters are like none."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        if not words or not self.words:
            return out
        rows, lengths = padded(words)
        for n in np.unique(lengths[lengths >= ORDER]).tolist():
            at, weight = _triples(n)
            members = np.flatnonzero(lengths == n)
            step = max(1, CELLS // len(at))
            for start in range(0, len(members), step):
                part = members[start : start + step]
                found = self.place[self._codes(rows[part, :n], at)]
                row, which = np.nonzero(found >= 0)
                if not len(row):
                    continue
                met, edge = np.unique(row, return_index=True)
                shared = np.add.reduceat(self.features[found[row, which]] * weight[which, None], edge, axis=0)
                mine = rows[part[met], :n]
                out[part[met]] = shared / np.sqrt(np.maximum(kernel(mine, mine)[:, None] * self.own, 1e-12))
        return np.minimum(out, 1.0)
