"""Secret scans: patterns find candidates, and how widely a candidate is owned over the corpus tells examples from live ones.

Every candidate value is known by a hash only. Over all rows, the distinct owners and distinct repositories of each hash
are counted; a value that many owners have is a widely copied example, one that hardly anybody else has and that looks random is
live-looking. Generic random-looking tokens become findings only when they are live-looking.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import names, scan, tokens
from siltstone.runtime import materialize

# The base patterns of the query's contract and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "generic")

#: A text without any of these has no ``assign`` match.
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
GENERIC_LEAST = 20
#: Bits of Shannon entropy per character from which a value looks random.
ENTROPY = 3.0
#: A value is live-looking up to so many distinct owners and repositories.
MAX_OWNERS, MAX_REPOSITORIES = 2, 8

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_GENERIC = np.zeros(256, bool)
_GENERIC[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True

_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("random", pa.bool_())])
FIELDS = "secret_candidates array<struct<kind:int,start:int,end:int,value:bigint,random:boolean>>"


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _candidate(kind: int, start: int, end: int, value: str) -> dict:
    digest = int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "big", signed=True)
    return {"kind": kind, "start": start, "end": end, "value": digest, "random": entropy(value) >= ENTROPY}


def find_candidates(column: pa.Array) -> pa.Array:
    """For each row its candidates by start, then kind; offsets are code points, ends exclusive. Base kinds (0 to 2) are
    leftmost non-overlapping matches per kind; generic ones (3) don't overlap a base match."""
    out = []
    buf, at = tokens.text_bytes(column)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for first, end in tokens.blocks(buf, at):
        part, rows = buf[at[first] : at[end]], at[first : end + 1] - at[first]
        for kind, table, least in ((2, _HEX, HEX_LEAST), (3, _GENERIC, GENERIC_LEAST)):
            starts, ends = tokens.word_spans(part, table, rows)
            for i in np.flatnonzero(ends - starts >= least):
                row = int(np.searchsorted(rows, starts[i], "right")) - 1
                runs.setdefault(first + row, []).append((kind, int(starts[i] - rows[row]), int(ends[i] - rows[row])))
    for row, text in enumerate(scan.as_text(column)):
        found = []
        low = text.lower()
        if any(k in low for k in _KEYWORDS):
            found += [_candidate(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [_candidate(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
        if row in runs:
            raw = text.encode()
            for kind, a, b in runs[row]:
                value = raw[a:b].decode()
                start = len(raw[:a].decode())
                if kind == 2:
                    found.append(_candidate(2, start, start + b - a, value))
                elif re.search("[0-9]", value) and re.search("[A-Za-z]", value):
                    found.append(_candidate(3, start, start + b - a, value))
        base = [c for c in found if c["kind"] < 3]
        found = base + [c for c in found if c["kind"] == 3 and c["random"] and not any(c["start"] < x["end"] and x["start"] < c["end"] for x in base)]
        out.append(sorted(found, key=lambda c: (c["start"], c["kind"], c["end"])))
    return pa.array(out, pa.list_(_CANDIDATE))


def scan_secrets(docs: DataFrame, *, text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``docs`` without its text, with secret_findings: an array of (kind, start, end, owners, repositories, verdict) by start
    and kind.

    Base kinds are all there, with the verdict ``live`` (random-looking and at most so many distinct owners and repositories) or
    ``example``; kind ``generic`` only if live. Null and empty texts have no findings. Null owners and repositories count as
    one unnamed one each. Repeated rows each get their result and count once for ownership. Columns called
    secret_findings or secret_candidates are replaced; an empty table gives an empty result.
    """
    gone = names.without(docs, "secret_findings", "secret_candidates")
    found = scan.add_columns(gone, [text_col], lambda c: [find_candidates(c)], FIELDS, drop=(text_col,))
    found = materialize(found, "secret-candidates")
    (key,) = names.fresh(found.columns, "secret_row")
    found = found.withColumn(key, F.monotonically_increasing_id())
    # The owner or repository column may be the text column, or one that is replaced; then it is read as unnamed.
    named = lambda c: names.col(c).cast("string") if c.lower() in {x.lower() for x in found.columns} else F.lit(None).cast("string")
    each = found.where(F.size("secret_candidates") > 0).select(names.col(key).alias("key"), named(owner_col).alias("owner"), named(repository_col).alias("repository"), F.explode("secret_candidates").alias("c"))
    value = F.col("c.value").alias("value")
    # Two steps each: a value's owners are made distinct before the shuffle, then counted.
    owners = each.select(value, F.coalesce("owner", F.lit("")).alias("owner")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    repositories = each.select(value, F.coalesce("repository", F.lit("")).alias("repository")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("repositories"))
    known = each.withColumn("value", F.col("c.value")).join(owners, "value").join(repositories, "value")
    live = F.col("c.random") & (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = known.withColumn("live", live).where("live or c.kind < 3")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("c.kind") + 1)
    item = F.struct(F.col("c.start").alias("start"), F.col("c.kind").alias("_kind"), F.col("c.end").alias("end"), kind.alias("kind"), "owners", "repositories", F.when(F.col("live"), "live").otherwise("example").alias("verdict"))
    listed = judged.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(item)).alias("secret_findings"))
    out = found.drop("secret_candidates").join(listed, key, "left").drop(key)
    return out.withColumn("secret_findings", F.coalesce("secret_findings", F.array().cast(listed.schema["secret_findings"].dataType)))


def redact(text: str, findings: list[dict]) -> str:
    """The text with every finding's span replaced by a mark."""
    out, at = [], 0
    for f in sorted(findings, key=lambda f: f["start"]):
        if f["end"] > at:
            out += [text[at : max(at, f["start"])], f"<{f['kind']}>"]
            at = f["end"]
    return "".join([*out, text[at:]])
