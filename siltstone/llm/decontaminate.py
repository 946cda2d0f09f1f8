"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all items, run once over each text.

The automaton reads word numbers instead of characters: words that no item has are all number 0. Where it finds windows,
the hit words' places in the normalised word list are mapped back to code point offsets of the original text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import names, scan, tokens
from siltstone.runtime import materialize, release, ship

WINDOW = 10
#: Bytes of item text that one automaton may be made from: some 140 MB of memory a megabyte, in each Python worker. More items take
#: several scans.
AUTOMATON_BYTES = 3 << 20

#: Bytes as the normalisation sees them: word bytes lower-cased, all others a space.
_NORMAL = bytes(int(tokens.FOLD[b]) if tokens.ALNUM[b] else 0x20 for b in range(256))

FIELDS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
#: Words of an item that are kept together.
SEGMENT_WORDS = 20_000


def normal_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z."""
    return text.translate(_NORMAL).split()


class Windows:
    """The automaton of some items' windows, made where it is first used."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items, self.window, self._built = items, window, None

    def __getstate__(self) -> dict:
        return {"items": self.items, "window": self.window, "_built": None}

    def built(self) -> tuple[dict[bytes, int], ahocorasick.Automaton | None]:
        if self._built is None:
            numbers: dict[bytes, int] = {}
            found: dict[tuple[int, ...], set[str]] = {}
            for item, text in self.items:
                words = tuple(numbers.setdefault(w, len(numbers) + 1) for w in normal_words((text or "").encode()))
                for i in range(max(1, len(words) - self.window + 1) if words else 0):
                    found.setdefault(words[i : i + self.window], set()).add(item)
            automaton = None
            if found:
                automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                for key, owners in found.items():
                    automaton.add_word(key, (len(key), tuple(owners)))
                automaton.make_automaton()
            self._built = numbers, automaton
        return self._built

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of hit words (first, end), merged; items with a window among the words."""
        numbers, automaton = self.built()
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if automaton and words:
            for last, (length, owners) in automaton.iter(tuple(map(numbers.get, words, repeat(0)))):
                items.update(owners)
                start = last + 1 - length
                while ranges and ranges[-1][1] >= start:
                    start = min(start, ranges.pop()[0])
                ranges.append((start, last + 1))
        return ranges, items


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((first, end))
    return out


def _spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code point offsets of ranges of words."""
    buf = np.frombuffer(text, np.uint8)
    starts, ends = tokens.word_spans(buf, tokens.ALNUM)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in ranges]


def _segments(window: int):
    """Rows (id, text): the item's normalised words in segments, each overlapping the next one by a window less one word, so that
    every window lies in one segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), scan.as_bytes(batch.column(1)), strict=True):
                words = normal_words(text)
                for start in range(0, max(1, len(words) - window + 1) if words else 0, SEGMENT_WORDS):
                    ids.append(item)
                    texts.append(b" ".join(words[start : start + SEGMENT_WORDS + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside a window's occurrence), items (sorted ids with an occurring window) and
    spans (code point ranges of the hit words in the original text).

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one window. Null and empty texts
    have no words; items without words have no window and null item ids count as the id "null". Repeated items and rows
    are fine: an item id counts once, every row gets its result. Empty tables give no rows, or no hits. Columns called like
    the added ones are replaced; others pass through, whatever their names.

    One automaton is made of all items, of ``automaton_bytes`` of text at most, and sent to the executors. Items beyond that are
    dealt over several by hash, and the texts are scanned once for each, one after the other, what was found so far being
    written beside them; driver and executors hold one automaton at a time.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.coalesce(names.col(item_id).cast("string"), F.lit("null")).alias("id"), names.col(item_text).cast("string").alias("text"))
    items = items.mapInArrow(_segments(window), "id string, text string")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / automaton_bytes))
    if parts > 1:
        items = materialize(items, "benchmark-segments")
    out = names.without(docs, "n_words", "n_hit", "items", "spans")
    so_far = names.fresh(out.columns, "found_items", "found_ranges")
    partial = f"{so_far[0]} array<string>, {so_far[1]} array<struct<first:int,end:int>>"
    for k in range(parts):
        part = Windows([tuple(r) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()], window)
        before = so_far if k else []
        if k == parts - 1:
            return scan.add_columns(out, [text_col, *before], _maker(part, True), FIELDS, drop=(*before, *(() if keep_text else (text_col,))))
        scanned = materialize(scan.add_columns(out, [text_col, *before], _maker(part, False), partial), "decontaminate-part")
        if k:
            release(out)
        out = scanned


def _maker(windows: Windows, last: bool):
    def make(column: pa.Array, *before: pa.Array) -> list[pa.Array]:
        earlier = list(zip(*(b.to_pylist() for b in before), strict=True)) if before else [([], [])] * len(column)
        n_words, n_hit, items, ranges, spans = [], [], [], [], []
        for text, (more_items, more_ranges) in zip(scan.as_bytes(column), earlier, strict=True):
            words = normal_words(text)
            hit, found = windows.search(words)
            if more_ranges:
                hit = _union([*hit, *((r["first"], r["end"]) for r in more_ranges)])
            n_words.append(len(words))
            n_hit.append(sum(b - a for a, b in hit))
            items.append(sorted(found.union(more_items)))
            ranges.append([{"first": a, "end": b} for a, b in hit])
            spans.append(_spans(text, hit) if last and hit else [])
        named = pa.array(items, pa.list_(pa.string()))
        if not last:
            return [named, pa.array(ranges, _pairs("first", "end"))]
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), named, pa.array(spans, _pairs("start", "end"))]

    return make


def _pairs(*names: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.int32()) for n in names]))
