"""Document fingerprints: bottom-k sketches of shingle hashes. DataFrame functions only.

A sketch holds the k least hashes of a document's distinct five-word shingles, ascending. Sketches of parts merge into the
sketch of the whole, and two sketches estimate resemblance, containment and distinct shingle counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from siltstone.llm import names
from siltstone.runtime import materialize, release

WORDS, K = 5, 256
#: Hashes have 60 bits: 15 hexadecimal digits in a fingerprint.
BITS = 60
#: Bytes of text that one range of documents holds at most in ``with_next``, about; small tables have so many ranges a core.
RANGE_BYTES, RANGES_A_CORE = 64 << 20, 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once for all its uses."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the text's shingles, in order, with repeats. Words are what spaces and U+0009 to U+000D separate, A-Z
    lower-cased. A text of fewer words is one shingle; null and a text without words have none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        rolling = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: _shingle(*[h[i + j] for j in range(words)]))
        return F.when(F.size(h) >= words, rolling).when(F.size(h) > 0, F.array(_shingle(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, windows)


def _shingle(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - BITS)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k least distinct shingle hashes, ascending; empty for null and for a text without words."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches were made from."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the part of the union's sketch that both have. Two empty sketches are alike (1.0), an empty
    and another are not (0.0)."""
    both = F.array_intersect(a, b)
    of_union = lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, both)) / F.size(u))
    return let(merge(a, b, k), of_union)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the hash range."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has: resemblance times the union's count over a's count, 1.0 at most."""
    count = distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / count))


def to_text(a: Column) -> Column:
    """A fingerprint as a string: 15 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def with_next(docs: DataFrame, derive: Callable[[Column, Column], dict[str, Column]], carry: dict[str, Callable[[Column], Column]], *, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` (id and text) in ascending order of ids, each beside the next document, after the last the first.

    ``derive(text, next_text)`` gives columns of the two texts; ``carry`` names functions of one text whose value for the next
    document is added as ``next_<name>``. Null texts are empty. Ids are integers, strings or dates; they may be null (first) and
    repeated (then by text hash); equal rows follow each other and stay in one range. One document alone is its own next.

    The order is cut into ranges. Where they begin is found by a range partitioning of ids and text hashes alone; these
    beginnings (a few tens of bytes a range) are all that reaches the driver. Texts then move once, to the task of their
    range. A range's first text also goes to the range before, behind its last document, so that no join is needed.
    """
    rows = docs.select(names.col(id_col).alias("id"), F.coalesce(names.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = materialize(rows.select("id", "tie", F.octet_length("text").alias("size")), "fingerprint-keys")
    count, size = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    ranges = max(1, min(count, max(math.ceil((size or 0) / range_bytes), RANGES_A_CORE * docs.sparkSession.sparkContext.defaultParallelism)))
    cut = keys.repartitionByRange(ranges, F.asc_nulls_first("id"), F.asc("tie"))
    heads = cut.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("id", "tie")).alias("head"))
    found, listed = heads.agg(F.count(F.lit(1)), F.to_json(F.sort_array(F.collect_list("head")))).first()
    release(keys)
    ranges = max(1, found)
    beginnings = F.from_json(F.lit(listed), ArrayType(heads.schema["head"].dataType))
    key = F.struct("id", "tie")
    at = _place(key, beginnings, ranges) - 1
    to = lambda r, copy: F.struct(r.cast("int").alias("range"), F.lit(copy).alias("copy"))
    own = lambda r: F.when(F.get(beginnings, r).eqNullSafe(key), F.array(to(r, False), to((r + ranges - 1) % ranges, True))).otherwise(F.array(to(r, False)))
    dealt = rows.select("id", "text", "tie", F.explode(let(at, own)).alias("to")).select("id", "text", "tie", "to.range", "to.copy")
    dealt = dealt.repartitionById(ranges, F.col("range"))
    dealt = dealt.withColumns({f"own_{name}": f(F.col("text")) for name, f in carry.items()})
    order = Window.partitionBy("range").orderBy("copy", F.asc_nulls_first("id"), "tie")
    paired = dealt.withColumns({"next": F.lead("text").over(order)} | {f"next_{name}": F.lead(f"own_{name}").over(order) for name in carry})
    derived = derive(F.col("text"), F.col("next"))
    named = [F.col("id").alias(id_col), F.col("text").alias(text_col), *[v.alias(n) for n, v in derived.items()], *[F.col(f"own_{n}").alias(n) for n in carry], *[F.col(f"next_{n}") for n in carry]]
    return paired.where(~F.col("copy")).select(*named)


def _place(key: Column, sorted_keys: Column, n: int) -> Column:
    """How many of the ``n`` sorted keys are at or below the key, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(sorted_keys, at + step - 1) <= key), at + step).otherwise(at))


def edited(text: Column, nxt: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many, or all, of the next one."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(nxt, F.lit(1), half))


def fingerprint_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document: its sketch, its edited text and that text's sketch, the next document's sketch.

    Null texts count as empty: an empty sketch. See ``with_next`` for null and repeated ids.
    """
    own = {"sketch": lambda t: sketch(t, k, words)}
    paired = with_next(docs, lambda text, nxt: {"edited_text": edited(text, nxt)}, own, id_col=id_col, text_col=text_col, range_bytes=range_bytes)
    return paired.withColumn("edited_sketch", sketch(F.col("edited_text"), k, words))
