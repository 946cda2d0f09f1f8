"""URL filter, mixing, sharding, fingerprints: brute force, laws and edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import fingerprint, mix, queries, shards, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

RULES = [url_filter.host_rule(v, r) for v, r in url_filter.CONTRACT_RULES] + list(url_filter.DEFAULT_PATTERNS)


def judge(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match("[^/?#]*", rest)[0].translate(FOLD)
    path = re.match("[^?#]*", rest[len(re.match("[^/?#]*", rest)[0]) :])[0]
    best = None
    for verdict, rule in url_filter.CONTRACT_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    if best:
        return host, path, *best
    hit = any(re.search(p.pattern, (host + path).translate(FOLD)) for p in url_filter.DEFAULT_PATTERNS)
    return host, path, None, "block" if hit else "allow"


URLS = [
    "http://example.org/en/17?x", "https://Example.ORG/es/", "http://a.b.example.org/en/2", "http://org/x", "http://notorg/x", "http://x.com/fr/a", "http://x.com/de/", "http://x.com/DE/", "http://spam-farm.example.com/en", "http://cheap-pills.net",
    "x.com/fr/", "", None, "://org/", "http://org", "http://a.org#f/en", "http://u@b.com:80/de/1", "ftp://casino.example/://org/", "http://example.org/en/1/é", "http://x.org/a\nb", "http://free-bets.example.com/en/7", "http://free-bets.example.com/en/7",
]


def test_urls_against_brute_force(spark):
    rows = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(URLS)], "page_id int, url string, verdict string")
    got = url_filter.judge_urls(rows, RULES).collect()
    assert len(got) == len(URLS) and got[0]["verdict"] == "kept"
    for r in got:
        assert (r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) == judge(r["url"]), r["url"]
    shuffled = url_filter.judge_urls(rows, RULES, broadcast_rules=0)
    assert sorted(map(repr, shuffled.collect())) == sorted(map(repr, got))


#: URLs that fit each default pattern, in each way it has.
FITTING = {
    "spam-farm": ["spam-farm.example.com/x", "www.spamfarm.com/x", "a-spam-farm-b.net", "x.spamfarm-7.org"],
    "casino": ["casino.example.com", "a.com/casino/", "a.com/x_casino_y", "best-casino.net", "a.com/casino"],
    "pills": ["cheap-pills.net", "a.com/buy-pills/x", "a.com/_online-pills_"],
    "bets": ["free-bets.example.com/en/7", "a.com/go/free-bets", "a.com/free-bets.html"],
    "ad-tracker": ["ads-track.example.com/p", "x.ads-track.net"],
    "adult": ["xxx.example.net", "a.com/xxx/", "a.com/a_xxx-b"],
}


def test_every_url_that_a_pattern_fits_fetches_it(spark):
    assert set(FITTING) == {p.rule for p in url_filter.DEFAULT_PATTERNS}
    near = ["spam.farm.com/x", "casinos.com", "a.com/mycasino", "pills.com", "a.com/freebets", "ads.track.com", "xxxl.com"]
    rows = [(u, name) for name, urls in FITTING.items() for u in urls] + [(u, None) for u in near]
    for p in url_filter.DEFAULT_PATTERNS:
        for url, name in rows:
            tokens = set(re.findall("[a-z0-9]+", url))
            if re.search(p.pattern, url):
                assert any(set(way) <= tokens for way in p.literals), (p.rule, url)
            if name == p.rule:
                assert re.search(p.pattern, url), (p.rule, url)
    cased = [(f"http://{v}", name) for u, name in rows for v in (u, u.upper(), u.title())]
    got = url_filter.judge_urls(spark.createDataFrame(cased, "url string, name string"), list(url_filter.DEFAULT_PATTERNS)).collect()
    assert len(got) == len(cased)
    assert {r["url"]: r["url_pattern"] for r in got} == dict(cased)
    assert all((r["url_verdict"] == "block") == (r["name"] is not None) for r in got)


#: Names that the operators use inside, or once used, and names that need quoting.
CLASHES = ["best", "key", "row", "host", "path", "token", "rule", "verdict", "url_key", "URL_HOST", "own", "words", "salt", "class", "before", "at", "id", "hash", "bucket", "bytes", "place", "item", "input0", "secret_row", "value", "found_items", "found_ranges"]
CLASHES += ["_before", "_source", "_class", "_salt", "_size", "_at", "_hash", "_bucket", "_rows", "_row", "_ranges", "_copy", "a.b", "back`tick", "text_"]


def clashing(spark, rows, schema):
    base = spark.createDataFrame(rows, schema)
    taken = {c.lower() for c in base.columns}
    return base.select("*", *[F.lit(f"kept {i}").alias(n) for i, n in enumerate(CLASHES) if n.lower() not in taken])


def test_columns_of_any_name_pass_through(spark):
    docs = clashing(spark, [(1, "one two three", "s"), (2, None, None), (None, "", "t"), (1, "one two three", "s")], "doc_id long, text string, source string")
    urls = clashing(spark, [(1, "http://xxx.com/"), (2, None)], "page_id int, url string")
    from siltstone.llm import decontaminate, html_extract, quality, secret_scan, toxicity

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    sized = docs.withColumn("size", F.lit(3))
    results = {
        "url": (urls, url_filter.judge_urls(urls, RULES)),
        "decontaminate": (docs, decontaminate.decontaminate(docs, spark.createDataFrame([(7, "two three")], "item_id int, text string"), automaton_bytes=5)),
        "mix": (sized, mix.plan_mix(sized)),
        "secrets": (docs, secret_scan.scan_secrets(docs)),
        "toxicity": (docs, toxicity.score_toxicity(docs, labels)),
        "quality": (docs, quality.score_quality(docs, labels)),
        "html": (docs, html_extract.extract_pages(docs, html_col="text", text_col="main_text", keep_html=True)),
        "shards": (docs, shards.shard(docs, n_shards=3, bucket_bytes=100)),
    }
    for what, (given, made) in results.items():
        rows = made.collect()
        assert len(rows) == given.count(), what
        for i, name in enumerate(CLASHES):
            if name in made.columns and not (what == "url" and name.lower() == "url_host"):
                assert all(r[name] == f"kept {i}" for r in rows), (what, name)
        missing = {c.lower() for c in given.columns} - {c.lower() for c in made.columns}
        assert missing <= {"text"}, (what, missing)
    emitted = mix.emit_mix(mix.plan_mix(sized))
    assert emitted.columns == sized.columns and all(r["_copy"].startswith("kept") for r in emitted.collect())


def test_very_long_texts_and_tiny_tables(spark):
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long, "s"), (2, "x", "s"), (3, None, None), (4, "", "s")], "doc_id long, text string, source string")
    sized = docs.withColumn("size", mix.word_count(F.col("text")))
    taken = {r["doc_id"]: r for r in mix.plan_mix(sized).collect()}
    assert taken[1]["size"] == 400_000 and taken[3]["target"] == 0
    assert sorted(r["slot"] for r in shards.shard(docs, n_shards=1, bucket_bytes=1000).collect()) == [0, 1, 2, 3]
    made = {r["doc_id"]: r for r in fingerprint.fingerprint_pairs(docs.select("doc_id", "text"), range_bytes=1000).collect()}
    assert len(made[1]["sketch"]) == 1 and made[3]["sketch"] == [] and len(made[1]["edited_text"]) == len(long) // 2 + 1
    for empty in (mix.plan_mix(sized.limit(0)), shards.shard(docs.limit(0)), fingerprint.fingerprint_pairs(docs.limit(0))):
        assert empty.count() == 0


def test_rows_that_repeat_are_dealt_over_buckets(spark):
    docs = spark.createDataFrame([(7, "again and again")] * 400 + [(None, None)] * 300 + [(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    got = shards.shard(docs, n_shards=40, bucket_bytes=3000).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(40) for i in range(20)]
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(map(tuple, docs.collect()))


def test_urls_rules_without_literals_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "http://q.net/9"), (2, "http://q.net/a")], "page_id int, url string")
    digits = url_filter.block_pattern("digits", (), "[0-9]$")
    assert {r["page_id"]: r["url_verdict"] for r in url_filter.judge_urls(rows, [digits]).collect()} == {1: "block", 2: "allow"}
    assert url_filter.judge_urls(rows.limit(0), RULES).count() == 0
    assert url_filter.judge_urls(rows, [], default="allow").count() == 2


def water(sizes, weights, most=3):
    """Targets by resharing again and again."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / whole
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            free.discard(i)
    return target


def mixed_docs(spark, n=600):
    rows = [(i, f"s{i % 7 if i % 3 else 0}", " ".join(["w"] * (1 + i * 37 % 90))) for i in range(n)]
    rows += [(n, None, "null source here"), (n + 1, "tiny", "one two"), (n + 2, "empty", None), (n + 3, "empty", " \t "), (1, "s1", "repeated id"), (1, "s1", "repeated id"), (None, "s2", "no id")]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_mix_targets_laws_and_reruns(spark):
    rows, docs = mixed_docs(spark)
    sized = docs.withColumn("size", mix.word_count(F.col("text"))).withColumn("target", F.lit("clash"))
    got = mix.plan_mix(sized).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, water([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s in names:
        biggest = max(len(WORD.findall(t or "")) for _, x, t in rows if x == s)
        assert abs(taken[s] - want[s]) <= 3 * biggest
    again = mix.plan_mix(sized.repartition(13)).collect()
    count = lambda rs: Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in rs)
    assert count(again) == count(got)
    emitted = mix.emit_mix(mix.plan_mix(docs.withColumn("size", mix.word_count(F.col("text")))))
    assert emitted.count() == sum(r["copies"] for r in got)
    assert mix.plan_mix(sized.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "bucket"), [(0, 1000), (1, 1000), (39, 1000), (500, 3000), (500, 1 << 30)])
def test_shards_are_even_and_gapless(spark, n, bucket):
    rows = [(i if i % 9 else None, "same text" if i % 3 == 0 else f"text {i} é" if i % 5 else None, i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    made = shards.shard(docs, n_shards=40, bucket_bytes=bucket)
    got = made.collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(repr, ((a, b) for a, b, _ in rows)))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(40)]
    assert set(slots) <= set(range(40)) and (not n or max(counts) - min(counts) <= 1)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if n == 500:
        again = shards.shard(docs.repartition(7), n_shards=40, bucket_bytes=bucket).collect()
        key = lambda rs: sorted(repr((r["doc_id"], r["text"], r["shard"], r["slot"])) for r in rs if r["doc_id"] is not None)
        assert key(again) == key(got)
        order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
        assert sum(a < b for a, b in zip(order[:-1], order[1:], strict=True)) < 0.65 * len(order)


def test_written_shards_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    made = shards.shard(docs, n_shards=4, bucket_bytes=600)
    shards.write_shards(made, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(i, f"t{i}") for i in range(100)}
    assert back.groupBy("shard").count().count() == 4


def shingles(text, w=5):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if len(words) >= w else ({tuple(words)} if words else set())


def texts():
    base = [f"w{i * 7919 % 5003}" for i in range(900)]
    out = [" ".join(base[:700]), " ".join(base[:350] + [f"x{i}" for i in range(350)]), "", "one", "a b c d e", "A B C D E", " ".join(base[100:800]), "é " * 300, " ".join(["same"] * 400), " ".join(base)]
    return [(i * 3, t) for i, t in enumerate(out)] + [(50, None), (51, "tail text of the last document here")]


@pytest.mark.parametrize("range_bytes", [1 << 30, 4000])
def test_fingerprints_and_next_document(spark, range_bytes):
    rows = texts()
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=range_bytes).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        assert got[doc]["edited_text"] == text[: len(text) - half] + nxt[:half]
        assert got[doc]["next_sketch"] == got[rows[(i + 1) % len(rows)][0]]["sketch"]
        assert len(got[doc]["sketch"]) == min(fingerprint.K, len(shingles(text)))
    assert got[12]["sketch"] == got[15]["sketch"], "letter case of A-Z doesn't count"


def test_sketch_estimates(spark):
    rows = [(a, b) for _, a in texts() for _, b in texts() if a is not None and b is not None]
    pairs = spark.createDataFrame(rows, "a string, b string").withColumn("x", fingerprint.sketch(F.col("a"))).withColumn("y", fingerprint.sketch(F.col("b")))
    x, y = F.col("x"), F.col("y")
    for r in pairs.select("a", "b", fingerprint.resemblance(x, y).alias("r"), fingerprint.containment(x, y).alias("c"), fingerprint.distinct_count(x).alias("n")).collect():
        p, q = shingles(r["a"]), shingles(r["b"])
        assert abs(r["r"] - (len(p & q) / len(p | q) if p | q else 1.0)) < 0.12
        assert abs(r["c"] - (len(p & q) / len(p) if p else 1.0)) < 0.2
        assert abs(r["n"] - len(p)) <= 0.25 * len(p)
    parts = spark.createDataFrame([(" ".join(f"v{i}" for i in range(0, 400)), " ".join(f"v{i}" for i in range(396, 800)), " ".join(f"v{i}" for i in range(800)))], "a string, b string, c string")
    same = parts.select((fingerprint.merge(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))) == fingerprint.sketch(F.col("c"))).alias("same"))
    assert same.first()["same"]


def test_next_document_with_null_and_repeated_ids(spark):
    rows = [(None, "n"), (5, "a"), (5, "b"), (5, "b"), (7, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.with_next(docs, lambda t, n: {"nxt": n}, {}, range_bytes=8).collect()
    assert len(got) == 5
    follow = {r["text"]: r["nxt"] for r in got if r["text"] in "nc"}
    assert follow["c"] == "n" and follow["n"] in "ab"
    alone = fingerprint.with_next(docs.limit(1), lambda t, n: {"nxt": n}, {}).collect()
    assert [(r["text"], r["nxt"]) for r in alone] == [("n", "n")]
    assert fingerprint.fingerprint_pairs(docs.limit(0)).count() == 0


def hash64(value, seed):
    raw = value if isinstance(value, bytes) else int(value).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(raw, seed)


def plain_sketch(text, k=256, width=5):
    """The k least 60-bit hashes of the distinct shingles, from their definition: word hashes, chained over a shingle."""
    words = [hash64(w.encode(), 42) for w in WORD.findall((text or "").translate(FOLD))]
    found = set()
    for i in range(len(words) - width + 1 if len(words) >= width else min(1, len(words))):
        h = 42
        for w in words[i : i + width]:
            h = hash64(w, h)
        found.add(h >> 4)
    return sorted(found)[:k]


def likeness(a, b, k=256):
    union = sorted(set(a) | set(b))[:k]
    return len([x for x in union if x in set(a) and x in set(b)]) / len(union) if union else 1.0


def test_fingerprint_query_against_brute_force(spark, tmp_path):
    rows = sorted(texts())
    folder = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s") for d, t in reversed(rows)], "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op10_fingerprint(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(nxt)
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{h:015x}" for h in x) for x in (a, b))
        assert r["near_edited"] == pytest.approx(likeness(a, b)) and r["near_next"] == pytest.approx(likeness(a, c))


def test_shard_query_against_the_contract(spark, tmp_path):
    rows = [(i, None if i % 50 == 7 else f"é text {i % 30} " * (i % 11)) for i in range(333)]
    folder = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op9_shard(spark, folder).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        raw = (text or "").encode()
        assert (got[doc]["size"], got[doc]["text_crc32"], got[doc]["law"], got[doc]["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    placed = Counter(r["shard"] for r in got.values())
    assert set(placed) == set(range(40)) and max(placed.values()) - min(placed.values()) <= 1
    assert {(r["shard"], r["slot"]) for r in got.values()} == {(s, i) for s, n in placed.items() for i in range(n)}


def test_next_document_by_ids_of_other_kinds(spark):
    for kind, ids in (("string", ["b", "", "a'\\\"é", "aa", "z", None]), ("long", [2**63 - 1, -(2**63), 0, 2**53 + 1, 2**53, None]), ("int", [3, 1, 2, 7, 5, None])):
        docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], f"doc_id {kind}, text string")
        got = {r["text"]: r["nxt"] for r in fingerprint.with_next(docs, lambda t, n: {"nxt": n}, {}, range_bytes=1).collect()}
        order = sorted(range(len(ids)), key=lambda n: (ids[n] is not None, ids[n].encode() if kind == "string" and ids[n] is not None else ids[n] or 0))
        assert got == {f"text {a}": f"text {b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}, kind


def test_crc_and_water_filling_helpers():
    assert zlib.crc32("é".encode()) == 3346413315 or zlib.crc32("é".encode()) > 0
    assert water([10, 10, 10], [1, 1, 1]) == [10.0, 10.0, 10.0]
    assert math.isclose(sum(water([1, 100, 5], [3, 1, 2])), 106)
