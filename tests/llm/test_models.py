"""Toxicity, quality, HTML and the pipeline: held-out labels, exact references, brute force, edge cases."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_native_ops import water
from test_text_ops import brute

import corpus_pipeline
from siltstone import runtime
from siltstone.llm import html_extract, html_pages, mix, quality, queries, toxicity
from siltstone.llm import labelled as labelled_rows
from siltstone.llm.decontaminate import normal_words
from siltstone.llm.html_tree import parse
from siltstone.llm.string_kernel import DECAY, Landmarks, kernel, padded, windows
from siltstone.runtime import materialize


def slow_kernel(s, t, p=3, decay=DECAY):
    """The sum over all pairs of equal subsequences, by their definition."""
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), p):
        for b in combinations(range(len(t)), p):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_against_its_definition():
    words = [b"idiot", b"idxiot", b"i", b"", b"ababab", b"abc", b"cab", b"stupid"]
    rows, _ = padded(words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert math.isclose(float(kernel(rows[i : i + 1], rows[j : j + 1])[0]), slow_kernel(s, t), rel_tol=1e-4, abs_tol=1e-6)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def test_windows_cover_long_words():
    long = bytes(range(97, 123)) * 3
    assert set(b"".join(windows(long))) == set(long) and windows(long)[-1][-1:] == long[-1:]


def test_similarities_are_the_normalised_kernel():
    rng = random.Random(1)
    marks = [bytes(rng.choices(b"abcd\xc3\xa9", k=rng.randrange(3, 9))) for _ in range(6)]
    words = [bytes(rng.choices(b"abcdxy\xc3\xa9", k=rng.randrange(1, 10))) for _ in range(30)]
    got = Landmarks(marks).similar(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            own = slow_kernel(w, w) * slow_kernel(m, m)
            assert got[i, j] == pytest.approx(min(1.0, slow_kernel(w, m) / math.sqrt(own)) if own else 0.0, abs=1e-4)


def test_similarity_tolerates_gaps():
    near = Landmarks([b"worthless"]).similar([b"worthless", b"wortxhless", b"worthles", b"weather", b"table", b"cabin"])[:, 0]
    assert near[0] == pytest.approx(1.0, abs=1e-4) and near[1] > 0.5 and near[2] > 0.5 and near[3] < 0.3 and near[5] == 0
    shared = slow_kernel(b"table", b"worthless") / math.sqrt(slow_kernel(b"table", b"table") * slow_kernel(b"worthless", b"worthless"))
    assert near[4] == pytest.approx(shared, abs=1e-4) and shared < 0.05, "t, l, e stand in both, far apart"


def labelled(spark, n=700):
    rng = random.Random(6)
    plain = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(3, 9))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(20, 120))
        toxic = i % 5 == 0
        good = i % 4 != 1
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["scoundrel", "blockhead", "nitwit"])
        if toxic and i % 3 == 0:
            words = [{"scoundrel": "sc-oun.drel", "blockhead": "bloxckhead", "nitwit": "n i t w i t"}.get(w, w) for w in words]
        if not good:
            words = [w.upper() + "!!" if rng.random() < 0.8 else w + "%%%" for w in words]
        rows.append((i, " ".join(words)))
        marks.append((i, int(good), int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 200_000), (n + 3, "a"), (5, rows[5][1]), (None, "no id")]
    return spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, label string"), spark.createDataFrame(marks + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), rows, marks


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows, marks = labelled(spark)
    got = toxicity.score_toxicity(docs, labels)
    assert got.columns == ["doc_id", "text", "label", "toxicity_score"]
    score = {(r["doc_id"], r["text"]): r["toxicity_score"] for r in got.collect()}
    assert got.count() == len(rows) and all(0 <= s <= 1 for s in score.values())
    held = [(score[rows[d]], t) for d, _, t in marks if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == t for s, t in held]) > 0.95


def test_quality_on_held_out_rows(spark):
    docs, labels, rows, marks = labelled(spark)
    score = {(r["doc_id"], r["text"]): r["quality_score"] for r in quality.score_quality(docs, labels).collect()}
    held = [(score[rows[d]], q) for d, q, _ in marks if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([(s >= 0.7) == q for s, q in held]) > 0.97
    assert all(0 <= s <= 1 for s in score.values())


@pytest.mark.parametrize(("name", "folds", "held", "least"), [("op6_toxicity", 5, 0, 0.5), ("op7_quality", 4, 2, 0.7)])
def test_scoring_queries_keep_the_contract(spark, tmp_path, name, folds, held, least):
    """Columns, fold and decision of every row against a plain computation; the score against the rows the query may learn from."""
    docs, labels, rows, marks = labelled(spark, 300)
    folder = str(tmp_path)
    docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    got = queries.queries()[name](spark, folder).collect()
    assert list(got[0].asDict()) == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows)
    for r in got:
        assert r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert r["predicted"] == int(r["score"] >= least) and 0 <= r["score"] <= 1
    column = 2 if name == "op6_toxicity" else 1
    truth = {m[0]: m[column] for m in marks}
    fair = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(fair) > 30 and np.mean(fair) > 0.9
    # Labels of the held-out fold are not learned from: turned round, they change no score.
    turned = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held
    other = str(tmp_path / "turned")
    docs.select("doc_id", "text", F.length("text").cast("long").alias("n_chars")).write.parquet(f"{other}/documents.parquet")
    labels.select("doc_id", *[F.when(turned, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")]).write.parquet(f"{other}/labels.parquet")
    again = queries.queries()[name](spark, other).collect()
    assert sorted(repr((r["doc_id"], r["score"])) for r in again) == sorted(repr((r["doc_id"], r["score"])) for r in got)


def test_sample_is_bounded_and_takes_an_id_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a")] + [(1, "c")] * 50 + [(2, "x"), (3, "y"), (None, "z"), (4, None), (6, "both")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (None, 1), (6, 0), (6, 1)], "doc_id long, quality int")
    rows, counts = labelled_rows.sample(docs, labels, "quality", folds=1, held_out=5, per_class=10)
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([("a", 1), (None, 1), ("x", 0), ("y", 0)], key=repr) and counts == {0: 2, 1: 2}
    assert labelled_rows.sample(docs, labels, "quality", folds=1, held_out=5, per_class=1)[0].count() == 2


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_without_labels_of_both_kinds(spark, score):
    docs, labels, rows, _ = labelled(spark, 40)
    assert score(docs, labels.limit(0)).count() == len(rows)
    one = labels.where("doc_id is not null").withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(1))
    assert score(docs, one).select(F.countDistinct(F.col(score(docs, one).columns[-1]))).first()[0] == 1
    assert score(docs.limit(0), labels).count() == 0


def test_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(2)
    texts = pa.array(["Some plain words here.", "ODD!! TEXT!! %%%", ""])
    words, stats = quality.describe(texts)
    meta = quality.one_hot(pa.array([[3], [9, 3], []], pa.list_(pa.int32())))
    model = quality.fit(words, stats, meta, np.array([1.0, 0.0, 1.0], np.float32), 0.6, steps=3)
    x = model.rows(words, stats, meta).astype(np.float64)
    v = model.factors.astype(np.float64)
    for i in range(3):
        on = np.flatnonzero(x[i])
        pairs = sum(float(v[a] @ v[b]) * x[i, a] * x[i, b] for k, a in enumerate(on) for b in on[:k])
        assert model.decide(model.rows(words, stats, meta))[i] == pytest.approx(model.bias + x[i] @ model.weights + pairs, abs=1e-3)
    assert rng is not None


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Ti&amp;tle</h1><p>First <b>bold</b>ly   said.<br>Then&nbsp;more &lt;x&gt; &copy;</p><!-- no --><div class="ad">Buy!</div><p>Second one is a longer paragraph.</article>
<aside class="sidebar"><p>Related</p></aside><form><p>Sign up</p><input></form><section id="comments"><h3>Comments</h3><p>I liked it very much, thank you.</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    model = html_extract.default_model()
    assert html_extract.extract(PAGE, model) == "Ti&tle First boldly said. Then more <x> © Second one is a longer paragraph."
    assert html_extract.extract("", model) == ""
    for odd in ("<", "<p", "</p></p>", "<article><p>a", "<!-- x", "<script>never", "&#0;&bogus;", "<p>" * 3000 + "deep"):
        assert isinstance(html_extract.extract(odd, model), str)


def test_marginals_are_exact():
    """Against the sum over all labellings of a small page."""
    from itertools import product

    page = parse("<div class=ad><p>x</p></div><article><p>words here</p><ul><li>y</li></ul></article>")
    found = html_extract.features(page)
    model = html_extract.TreeModel([((i * 37) % 11 - 5) / 4 for i in range(html_extract.FEATURES)], [[0.4, -0.9, -0.3, 0.8], [0.1, 0.2, -0.5, 0.6], [-0.7, 0.3, 0.2, 0.0], [0.3, 0.3, -0.2, 0.9]])
    weights = np.zeros(len(page.nodes))
    total = 0.0
    for ys in product((0, 1), repeat=len(page.nodes)):
        w = math.exp(sum(y * sum(model.unary[f] for f in fs) for y, fs in zip(ys, found, strict=True)) + sum(model.edge[html_extract.edge_kinds(page)[i]][2 * ys[n.parent] + ys[i]] for i, n in enumerate(page.nodes) if i))
        total += w
        weights += w * np.array(ys)
    assert np.allclose(model.marginals(page, found)[0], weights / total)


def test_held_out_pages():
    model = html_extract.default_model()
    right = total = 0
    for text, labels in html_pages.labelled_pages(60, seed=123):
        page = parse(text)
        probabilities, _ = model.marginals(page, html_extract.features(page))
        right += sum((p >= 0.5) == y for p, y in zip(probabilities, labels, strict=True))
        total += len(labels)
    assert right / total > 0.95


def test_pages_frame(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (1, "u", PAGE)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert sorted((r["page_id"], len(r["main_text"]) > 20) for r in got) == [(1, True), (1, True), (2, False), (3, False)]


def test_page_query_on_a_fixture(spark, tmp_path):
    tail = " ".join(f"word{i}" for i in range(3000))
    long = PAGE.replace("Second one is a longer paragraph.", f"Second one is a longer paragraph. {tail}")
    rows = [(1, "u", PAGE), (2, "v", long), (3, None, None), (4, "w", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op8_html_extract(spark, str(tmp_path)).collect()}
    text = "Ti&tle First boldly said. Then more <x> \u00a9 Second one is a longer paragraph."
    assert got == {1: ("u", text, len(text)), 2: ("v", f"{text} {tail}", len(text) + 1 + len(tail)), 3: (None, "", 0), 4: ("w", "", 0)}


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_real_pages_match_the_article(spark):
    pages = queries.op8_html_extract(spark, "/root/testdata/sf0.01").collect()
    source = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in pages:
        inside = source[r["page_id"]].partition("<article>")[2].partition("</article>")[0]
        inside = re.sub(r"<[^>]*$", "", inside)
        assert r["text"] == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]+>", " ", inside))).split())
        assert r["n_chars"] == len(r["text"])


def pipeline_tables(spark, folder):
    docs, labels, rows, marks = labelled(spark, 260)
    bench = " ".join(f"bench{i}" for i in range(14))
    extra = [(1000, rows[0][1] + " tail"), (1001, "lead " + bench + " end"), (1002, rows[2][1]), (1003, None)]
    everything = [(d, t) for d, t in rows if t is None or len(t) < 10_000] + extra
    frame = spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in everything], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return everything


def taken_copies(rows, seed=7):
    """How often the mix takes each (doc_id, source, words): sizes in order, one running sum and one offset a source."""
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    sizes = Counter()
    for _, source, words in rows:
        sizes[source] += words
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    target = dict(zip(names, water([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    out = Counter()
    for source in names:
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (math.isqrt(r[2]), number(f"{seed}:{'' if r[0] is None else r[0]}") % mix.SALTS, r[2], -1 if r[0] is None else r[0]))
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        offset = number(f"{seed}:" + ("" if source is None else "s" + source)) / 2**32
        for i, r in enumerate(own):
            out[r] += min(3, math.floor((i + 1) * rate + offset) - math.floor(i * rate + offset))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's rows against a plain computation from the rows of the stage before, and the whole run's rows."""
    folder = str(tmp_path)
    everything = pipeline_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    stage = dict(corpus_pipeline.STAGES)
    pairs = lambda frame: Counter((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())

    given = materialize(docs, "test")
    kept = materialize(stage["quality"](spark, given, folder), "test")
    scores = {(r["doc_id"], r["text"]): r["quality_score"] for r in quality.score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"), metadata=("n_chars",)).collect()}
    assert kept.columns == docs.columns
    assert pairs(kept) == Counter({k: n for k, n in pairs(docs).items() if scores[k] >= 0.7})
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    right = [(d in {x for x, _ in pairs(kept)}) == marks[d] for d, _ in everything if marks.get(d) is not None]
    assert np.mean(right) > 0.97

    before = pairs(kept)
    kept = materialize(stage["near_duplicates"](spark, kept, folder), "test")
    whole = {d: t for d, t in before if d is not None}
    joined = brute(list(whole.items()), 5, 80)
    want = Counter({(d, t): 1 for d, t in before if d is not None and joined[d][1] == d}) + Counter({k: n for k, n in before.items() if k[0] is None})
    assert len(whole) == len([k for k in before if k[0] is not None]), "no id has two texts here"
    assert pairs(kept) == want and (1000, everything[0][1] + " tail") not in want

    bench = normal_words((" ".join(f"bench{i}" for i in range(14))).encode())
    windows_of = {tuple(bench[i : i + 10]) for i in range(len(bench) - 9)}
    hit = lambda text: any(tuple(w[i : i + 10]) in windows_of for w in [normal_words((text or "").encode())] for i in range(len(w) - 9))
    kept = materialize(stage["decontaminate"](spark, kept, folder), "test")
    want = Counter({k: n for k, n in want.items() if not hit(k[1])})
    assert pairs(kept) == want and not any(d == 1001 for d, _ in want)

    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["text"]) for r in kept.collect()]
    copies = taken_copies([r[:3] for r in rows])
    kept = materialize(stage["mix"](spark, kept, folder), "test")
    want = Counter()
    for d, source, words, text in rows:
        want[d, text] += copies[d, source, words]
    assert kept.columns == docs.columns and pairs(kept) == +want

    last = stage["shard"](spark, kept, folder)
    assert last.columns == [*docs.columns, "shard", "slot"] and pairs(last) == +want
    placed = Counter((r["shard"], r["slot"]) for r in last.collect())
    counts = np.bincount([s for s, _ in placed], minlength=40)
    assert max(placed.values()) == 1 and counts.max() - counts.min() <= 1 and all((s, i) in placed for s in range(40) for i in range(counts[s]))

    tables = set(runtime._WRITTEN)
    run = corpus_pipeline.run(spark, folder)
    row = lambda frame: sorted(repr((r["doc_id"], r["text"], r["shard"], r["slot"])) for r in frame.collect())
    assert row(run) == row(last)
    assert len(set(runtime._WRITTEN) - tables) <= 2, "what a stage wrote for itself is removed"


def test_ids_with_several_texts_lose_only_copies(spark):
    shared, other = "one two three four five six seven eight nine ten", "quite another text that nothing else in this table is like"
    rows = [(1, shared), (5, shared), (5, other), (6, "x"), (7, "y"), (7, "y"), (8, None), (8, None), (9, ""), (None, "y"), (None, "y"), (11, "A b c d e f"), (11, "a b c d e f")]
    docs = spark.createDataFrame([(d, t, "kept") for d, t in rows], "doc_id long, text string, text_hash string")
    got = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    found = Counter((r["doc_id"], r["text"]) for r in got.collect())
    first = [k for k in found if k[0] == 11]
    assert len(first) == 1
    assert found - Counter(first) == Counter([(1, shared), (5, other), (6, "x"), (7, "y"), (8, None), (9, ""), (None, "y"), (None, "y")])


def test_hits_add_up_and_kernels_are_exact():
    mark = Landmarks([b"bomentemi"])
    words = [b"bomentado", b"momento", b"table", b"bomentemi"]
    got, (rows, _) = mark.similar(words)[:, 0], padded(words)
    for i in range(len(words)):
        own = float(kernel(rows[i : i + 1], rows[i : i + 1])[0] * mark.own[0])
        assert got[i] == pytest.approx(float(kernel(rows[i : i + 1], padded(mark.words)[0])[0]) / math.sqrt(own), abs=1e-5)
    assert 0 < got[1] < 0.7 and got[0] > 0
    reader = toxicity.Reader(mark)
    once, often, short, none = reader.texts(pa.array(["plain bomentemi", "bomentemi plain " * 8, "bomentado", ""]))[:, 0]
    assert often > 2 * once > 0 and 0 < short < once and none == 0
    assert reader.texts(pa.array(["plain bomentemi " * 40_000]))[0, 0] == pytest.approx(math.log1p(40_000), abs=1e-2)
