"""N-gram Jaccard join by prefix trees.

1. Every document becomes its set of word n-gram hashes. Documents with equal sets are one class.
2. Which classes could link at all, by prefix filters. In the order of their hashes, the first n-grams of two linked sets
   (twice the share in which they may differ) have a known number in common. Only these are counted over the corpus; a
   class with fewer shared ones among them drops out. Of a class's shared ones, rarest first, so many come before that
   number that one of them must be common too: these are its signs. Classes with a common sign are chained to the least
   of them, and the chains' components are the clusters; two linked classes are always in one cluster.
3. Each cluster is cut into bands of set sizes such that linked sets are in one band or in neighbouring ones, and the bands into
   chunks of bounded size. Each pair of chunks that can hold a link is a block. Inside a block the sets, in one order of
   all its n-grams (most frequent first), are a prefix tree. All queries of the block walk down it together: what they
   overlap with a shared path is counted once, and a subtree is left by each query for which the overlap so far plus the
   shorter of the two remaining lengths cannot reach the threshold.
4. The links' components, found from a spanning forest of each block, are the result.

No pair of documents is ever a row. Whole sets are only made of documents in clusters. An n-gram or sign that very many
documents have doesn't meet in one task: what a task sees often it settles itself, and passes on in one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import tokens
from siltstone.llm.components import components
from siltstone.llm.names import col
from siltstone.runtime import materialize, release, ship, small

#: Counts of an n-gram are told apart up to this; those beyond count as equally frequent.
MOST_COUNTED = 1024
#: Rows that a task looks at together, and how often an n-gram is among them to count as frequent everywhere.
FLUSH_ROWS, OFTEN = 200_000, 64
#: Parts that the rows of a frequent n-gram are dealt over. A row's part is in its tag, above this bit; what is below is ``least``.
SALTS, TAG_BIT = 4096, 40
#: N-grams in a chunk of a cluster. A longer document is a chunk of its own.
CHUNK_GRAMS = 400_000
#: Cells of the membership matrix that one slice of queries may have.
SLICE_CELLS = 8_000_000
#: Ids and places of documents are broadcast to a scan of the texts up to so many bytes; more are joined by shuffling.
BROADCAST_BYTES = 64 << 20


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """Of a set of ``n``: how many n-grams its prefix has, and how many of them it shares with the prefix of each linked set.

    A linked set lacks at most n - ceil(t n) of them. With l = ceil((1 - t) n) more than that in the prefix, the set whose prefix
    ends first has l of its own in common with the other's; the least linked set has ceil(t n), hence its l counts.
    """
    need = -(-n * percent // 100)
    return n - need + -(-n * (100 - percent) // 100), max(1, -(-need * (100 - percent) // 100))


def gram_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    for first, end, hashed, at in tokens.hashed_words(column, tokens.SPACED):
        for i in range(end - first):
            yield np.unique(tokens.shingles(hashed[at[i] : at[i + 1]], words))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _outline(words: int):
    """Rows (id, text, hash): the size of the set and 128 bits that stand for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2 = [], [], []
            for grams in gram_sets(batch.column(1), words):
                mixed = tokens.mix64(grams)
                n.append(len(grams))
                s1.append(mixed.sum(dtype=np.uint64).view(np.int64))
                s2.append(np.bitwise_xor.reduce(tokens.mix64(mixed ^ np.uint64(77)), initial=np.uint64(0)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in (n, s1, s2))], ["id", "hash", "n", "s1", "s2"])

    return run


def _prefix(words: int, percent: int):
    """Rows (node, text): a row (gram, node, tag) for each n-gram of the set's prefix. Its tag is ``least``, and above it a salt, which
    is 0 but where the n-gram is frequent among the rows seen with it; then one more row with the tag 0 says so to all others."""

    def out(made: list[np.ndarray], owners: list[np.ndarray], least: list[np.ndarray]) -> pa.RecordBatch:
        gram, node, need = np.concatenate(made).view(np.int64), np.concatenate(owners).astype(np.int64), np.concatenate(least)
        values, inverse, counts = np.unique(gram, return_inverse=True, return_counts=True)
        often = counts >= OFTEN
        salt = np.where(often[inverse], 1 + np.arange(len(gram)) % SALTS, 0)
        told = values[often]
        nothing = np.zeros(len(told), np.int64)
        return _rows(["gram", "node", "tag"], np.append(gram, told), np.append(node, nothing), np.append((salt << TAG_BIT) | need, nothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, owners, least, size = [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for node, grams in zip(ids, gram_sets(batch.column(1), words), strict=True):
                if len(grams):
                    count, shared = prefix_sizes(len(grams), percent)
                    made.append(grams[:count])
                    owners.append(np.full(count, node))
                    least.append(np.full(count, shared, np.int32))
                    size += count
                if size > FLUSH_ROWS:
                    yield out(made, owners, least)
                    made, owners, least, size = [], [], [], 0
        if made:
            yield out(made, owners, least)

    return run


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _starts(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, node, tag) sorted by gram: those whose gram is in two prefixes or more, with its count,
    MOST_COUNTED at most and for all that are frequent somewhere. No more rows than that are held for a gram."""
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    frequent = None

    def out(columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = (counts > 1) & (columns[2] > 0)
        if keep.any():
            gram, node, least = (c[keep] for c in columns)
            yield _rows(["node", "least", "count", "gram"], node, least, counts[keep].astype(np.int32), gram)

    for batch in batches:
        gram, node, tag = (c.to_numpy() for c in batch.columns)
        least, salted = (tag & ((1 << TAG_BIT) - 1)).astype(np.int32), tag >> TAG_BIT != 0
        if salted.any():
            yield from out([c[salted] for c in (gram, node, least)], np.full(int(salted.sum()), MOST_COUNTED))
            gram, node, least = (c[~salted] for c in (gram, node, least))
        columns = [np.concatenate([h, c]) for h, c in zip(held, (gram, node, least), strict=True)]
        if not len(columns[0]):
            continue
        starts = _starts(columns[0])
        sizes = np.diff(np.append(starts, len(columns[0])))
        sums = np.add.reduceat(np.where(columns[2] > 0, 1, MOST_COUNTED), starts)
        if columns[0][0] == frequent:
            sums[0] = MOST_COUNTED
        counts = np.repeat(np.minimum(sums, MOST_COUNTED), sizes)
        last = int(starts[-1])
        if sums[-1] >= MOST_COUNTED:  # known to be frequent, however many follow
            frequent, last = columns[0][-1], len(columns[0])
        yield from out([c[:last] for c in columns], counts[:last])
        held = [c[last:] for c in columns]
    yield from out(held, np.full(len(held[0]), len(held[0])))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, least, count, gram) sorted by node, count, gram: rows (key, node, other). Nodes of one sign that are seen together
    are chained here, and these edges have a key of their own; of each sign one row (sign, node, null) goes on."""
    made: list[tuple[np.ndarray, np.ndarray]] = []

    def signs(columns: list[np.ndarray]) -> None:
        node, least, gram = columns
        if not len(node):
            return
        starts = _starts(node)
        sizes = np.diff(np.append(starts, len(node)))
        place = np.arange(len(node)) - np.repeat(starts, sizes)
        keep = place < np.repeat(sizes, sizes) - least + 1
        made.append((gram[keep], node[keep]))

    def out() -> Iterator[pa.RecordBatch]:
        if not made:
            return
        sign, node = (np.concatenate(c) for c in zip(*made, strict=True))
        order = np.lexsort((node, sign))
        sign, node = sign[order], node[order]
        starts = _starts(sign)
        heads = np.repeat(node[starts], np.diff(np.append(starts, len(node))))
        apart = heads != node
        edges = np.unique(np.stack([node[apart], heads[apart]]), axis=1)
        key, own = np.append(edges[0], sign[starts]), np.append(edges[0], node[starts])
        other = pa.array(np.append(edges[1], node[starts]), mask=np.arange(len(key)) >= edges.shape[1])
        made.clear()
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), other], ["key", "node", "other"])

    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
    for batch in batches:
        columns = [np.concatenate([h, batch.column(i).to_numpy()]) for h, i in zip(held, (0, 1, 3), strict=True)]
        if not len(columns[0]):
            continue
        last = int(_starts(columns[0])[-1])
        signs([c[:last] for c in columns])
        held = [c[last:] for c in columns]
        if sum(len(g) for g, _ in made) > FLUSH_ROWS:
            yield from out()
    signs(held)
    yield from out()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, other): those with another node are edges already; the others, sorted by key and node, give an edge from
    each node to the first one with the same sign."""
    sign, head = None, None
    for batch in batches:
        ready = batch.filter(batch.column(2).is_valid())
        if ready.num_rows:
            yield pa.RecordBatch.from_arrays([ready.column(1), ready.column(2)], ["a", "b"])
        batch = batch.filter(batch.column(2).is_null())
        if not batch.num_rows:
            continue
        signs, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = _starts(signs)
        heads = np.repeat(nodes[starts], np.diff(np.append(starts, len(signs))))
        if sign is not None and signs[0] == sign:
            heads[: int(starts[1]) if len(starts) > 1 else len(signs)] = head
        sign, head = signs[-1], heads[-1]
        apart = heads != nodes
        pairs = np.unique(np.stack([nodes[apart], heads[apart]]), axis=1)
        if pairs.size:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _deal(words: int):
    """Rows (node, text, copies, root, band, chunk, own, below, above): the set, once for each block that it is part of. ``own``, ``below``
    and ``above`` are the numbers of chunks in its band and the neighbouring ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7, 8)]
            rows, grams_out = [], []
            for (node, copies, root, band, chunk, own, below, above), grams in zip(zip(*columns, strict=True), gram_sets(batch.column(1), words), strict=True):
                here = band << 32 | chunk
                others = [*((band - 1) << 32 | j for j in range(below)), *(band << 32 | j for j in range(own)), *((band + 1) << 32 | j for j in range(above))]
                for other in others:
                    rows.append((root, min(here, other), max(here, other), here, node, copies))
                    grams_out.append(grams)
                    if len(rows) == 256:
                        yield _dealt(rows, grams_out)
                        rows, grams_out = [], []
            if rows:
                yield _dealt(rows, grams_out)

    return run


def _dealt(rows: list[tuple], grams: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), _lists(grams)], ["root", "one", "two", "chunk", "node", "copies", "grams"])


class PrefixTree:
    """Sets of ranks as a path-compressed trie: the sets in lexicographic order, and the length that each shares with the
    one before."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()), np.int64)
        self.sets = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.lengths = np.array([len(s) for s in self.sets], np.int64)
        self.shared = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            self.shared[i] = int(differ.argmax()) if differ.any() else m

    def probe(self, member: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int]]:
        """For each set of the tree that some query links with: the rows of those queries, the set's index. ``member``: for
        each query and rank whether it has it; ``sizes``: the queries' sizes, n-grams that nothing shares included."""
        upto = np.zeros((member.shape[0], member.shape[1] + 1), np.int32)
        np.cumsum(member, axis=1, out=upto[:, 1:])
        total = upto[:, -1]
        stack = [(0, len(self.sets), 0, np.arange(len(sizes)), np.zeros(len(sizes), np.int64))]
        while stack:
            low, high, depth, alive, overlap = stack.pop()
            end = int(self.shared[low + 1 : high].min()) if high - low > 1 else int(self.lengths[low])
            path = self.sets[low][depth:end]
            if len(path):
                overlap = overlap + member[np.ix_(alive, path)].sum(axis=1)
            last = int(self.sets[low][end - 1]) + 1 if end else 0
            ahead = np.minimum(total[alive] - upto[alive, last], int(self.lengths[low:high].max()) - end)
            keep = (100 + percent) * (overlap + ahead) >= percent * (sizes[alive] + int(self.sizes[low:high].min()))
            alive, overlap = alive[keep], overlap[keep]
            if not len(alive):
                continue
            while low < high and self.lengths[low] == end:  # sets that end here come first
                linked = (100 + percent) * overlap >= percent * (sizes[alive] + int(self.sizes[low]))
                if linked.any():
                    yield alive[linked], int(self.order[low])
                low += 1
            if low < high:
                cuts = [low, *(low + 1 + np.flatnonzero(self.shared[low + 1 : high] == end)), high]
                stack += [(int(a), int(b), end, alive, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def join_block(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """All linked pairs (query of ``left``, set of ``right``) of a block, each unordered pair once."""
    sizes = np.array([len(g) for g in grams], np.int64)
    values, inverse, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = counts > 1
    rank = np.full(len(values), -1, np.int64)
    order = np.flatnonzero(shared)[np.argsort(-counts[shared], kind="stable")]
    rank[order] = np.arange(len(order))
    ranked, at = [], 0
    for g in grams:
        r = rank[inverse[at : at + len(g)]]
        at += len(g)
        ranked.append(np.sort(r[r >= 0]))
    tree = PrefixTree([ranked[i] for i in right], sizes[right])
    step = max(1, SLICE_CELLS // max(1, len(order)))
    for start in range(0, len(left), step):
        queries = left[start : start + step]
        member = np.zeros((len(queries), len(order)), bool)
        for row, q in enumerate(queries):
            member[row, ranked[q]] = True
        for rows, found in tree.probe(member, sizes[queries], percent):
            d = int(right[found])
            for q in queries[rows]:
                if q != d and (q < d or not np.array_equal(left, right)):
                    yield int(q), d


def _join_blocks(percent: int):
    """Rows (root, one, two, chunk, node, copies, grams) sorted by block: (a, b, links) with a's links in the block, and b
    the least node that a is linked to there."""

    def solve(rows: list[tuple]) -> tuple[list, list, list]:
        one, two = rows[0][1], rows[0][2]
        rows = list({(r[4], r[6].tobytes()): r for r in rows}.values())  # repeated rows of a document
        chunk = np.array([r[3] for r in rows])
        left = np.flatnonzero(chunk == one)
        right = np.flatnonzero(chunk == two)
        grams, ids, copies = [r[6] for r in rows], [r[4] for r in rows], [r[5] for r in rows]
        parent, links = list(range(len(rows))), [0] * len(rows)

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if len(left) and len(right):
            for q, d in join_block(grams, left, right, percent):
                links[q] += copies[d]
                links[d] += copies[q]
                x, y = find(q), find(d)
                if x != y:
                    parent[max(x, y, key=lambda i: ids[i])] = min(x, y, key=lambda i: ids[i])
        linked = [i for i in range(len(rows)) if links[i]]
        return [ids[i] for i in linked], [ids[find(i)] for i in linked], [links[i] for i in linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            lists = batch.column(6)
            values, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                row = (*(c[i] for c in columns), values[at[i] : at[i + 1]].copy())
                if held and held[0][:3] != row[:3]:
                    yield from out(solve(held))
                    held = []
                held.append(row)
        if held:
            yield from out(solve(held))

    def out(found: tuple[list, list, list]) -> Iterator[pa.RecordBatch]:
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b", "links"])

    return run


def _with_rows(texts: DataFrame, wanted: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``texts`` (id, hash) joined with the rows wanted of them, by id, which makes a small hash table, then told apart by hash."""
    wanted = wanted.withColumnsRenamed({"id": "wanted_id", "hash": "wanted_hash"})
    same = (F.col("id") == F.col("wanted_id")) & (F.col("hash").bitwiseXOR(F.col("wanted_hash")) == 0)
    return texts.join(small(wanted, broadcast_bytes), same)


def _in_chunks(members: DataFrame, percent: int, chunk_grams: int) -> DataFrame:
    """``members`` (node, n, copies, root, id, hash) with their band and chunk and the numbers of chunks around (see ``_deal``).

    With a band width of a little over the logarithm of 100 / percent, the sizes of linked sets are less than one width apart.
    """
    width = math.log(100 / percent) * 1.000001
    band = F.floor(F.log("n") / width) if width else F.col("n")
    members = members.withColumn("band", band.cast("long"))
    whole = members.groupBy("root", "band").agg(F.ceil(F.sum("n") / chunk_grams).cast("int").alias("chunks"))
    side = lambda shift, name: F.struct((F.col("band") + shift).alias("band"), F.lit(name).alias("side"), "chunks")
    around = whole.select("root", F.inline(F.array(side(0, "own"), side(1, "below"), side(-1, "above"))))
    around = around.groupBy("root", "band").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("chunks"))), F.lit(0)).cast("int").alias(s) for s in ("own", "below", "above")]).where("own > 0")
    chunk = F.pmod(F.xxhash64("node"), "own").cast("int").alias("chunk")
    return members.join(small(around), ["root", "band"]).select("id", "hash", "node", "copies", "root", "band", chunk, "own", "below", "above")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90, chunk_grams: int = CHUNK_GRAMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, n_links, and text_hash, the text's ``xxhash64``.

    Words are what spaces and U+0009 to U+000D separate, A-Z lower-cased; a text's set has its distinct ``words``-grams, or
    the whole sequence where there are fewer words. Rows link when the intersection is ``percent`` percent of the union or
    more. component_id is the least id reachable by links; n_links counts the other rows that a row links with directly.

    Null texts, empty texts and texts without words have an empty set and link with nothing: component_id is their own id.
    Rows with a null id link with nothing and have a null component_id. Rows that repeat an id are rows of their own: copies that
    link where the text is repeated too, else linked by their texts alone. Other columns are not looked at. An empty table gives
    an empty result. Ids are 64-bit integers.
    """
    ship(docs.sparkSession)
    given = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    hashed = given.withColumn("hash", F.xxhash64("text"))
    outline = materialize(hashed.mapInArrow(_outline(words), "id long, hash long, n long, s1 long, s2 long"), "ngram-outline")
    key, row = ["n", "s1", "s2"], ["id", "hash"]
    classes = outline.where("n > 0 and id is not null").groupBy(*key).agg(F.min(F.struct(*row)).alias("head"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select(*key, "copies", "head.*", F.xxhash64(*key).alias("node")), "ngram-classes")
    heads = _with_rows(hashed, classes.select(*row, "node"), broadcast_bytes).select("node", "text")
    prefixes = heads.mapInArrow(_prefix(words, percent), "gram long, node long, tag long")
    shared = prefixes.repartition("gram", F.shiftright("tag", TAG_BIT)).sortWithinPartitions("gram").mapInArrow(_counted, "node long, least int, count int, gram long")
    signed = shared.repartition("node").sortWithinPartitions("node", "count", "gram").mapInArrow(_sign, "key long, node long, other long")
    chained = signed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_chain, "a long, b long")
    clusters = components(chained)
    members = _in_chunks(clusters.join(classes.select("node", "n", "copies", *row), "node"), percent, chunk_grams)
    members = materialize(members, "ngram-members")
    texts = _with_rows(hashed, members, broadcast_bytes).select("node", "text", "copies", "root", "band", "chunk", "own", "below", "above")
    dealt = texts.mapInArrow(_deal(words), "root long, one long, two long, chunk long, node long, copies long, grams array<long>")
    block = ["root", "one", "two"]
    links = dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(_join_blocks(percent), "a long, b long, links long")
    links = materialize(links, "ngram-links")
    release(members)
    roots = components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    solved = classes.join(roots, "node", "left").join(counts, "node", "left")
    least = solved.where("root is not null").groupBy("root").agg(F.min("id").alias("component"))
    solved = solved.join(least, "root", "left").select(*key, F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    rows = outline.join(solved, key, "left")
    known = F.col("id").isNotNull()
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component", "id")).alias("component_id"), F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.col("hash").alias("text_hash"))
