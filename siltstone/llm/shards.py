"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets that fit in memory, by a seeded hash of the record. Pass two shuffles each bucket
on its own by Fisher-Yates (Spark's ``shuffle``) and writes it at the bucket's place in the whole order. The order is cut
into shards of equal length, so the counts of two shards differ by one at most. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import names
from siltstone.runtime import materialize

#: Bytes of text that a bucket should hold.
BUCKET_BYTES = 24 << 20
#: Up to so many buckets their offsets (16 bytes each) are broadcast; beyond they are joined by shuffling.
BROADCAST_BUCKETS = 1_000_000


def shard(docs: DataFrame, *, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, bucket_bytes: int = BUCKET_BYTES, broadcast_buckets: int = BROADCAST_BUCKETS) -> DataFrame:
    """``docs`` with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard) added, by the law ``rows``.

    The bucket of a row hangs on its id and text, so copies of a text under several ids are dealt all over. Null ids and
    texts are values like any other; repeated rows each keep their row and get slots of their own. Rows of one id and text that
    would overfill a bucket are dealt over several in turn. Texts longer than a bucket make that bucket longer. An empty table
    gives an empty result. Other columns, whatever their names, pass through; shard and slot replace columns so called. Reruns
    over the same rows give the same places (up to the order of rows of one id and text).
    """
    given = names.without(docs, "shard", "slot")
    weight = F.coalesce(F.octet_length(names.col(text_col)), F.lit(0)) + 64
    hashed = given.select(F.xxhash64(F.lit(seed), names.col(id_col), names.col(text_col)).alias("hash"), weight.alias("bytes"), F.struct(*names.cols(given.columns)).alias("row"))
    keys = materialize(hashed.select("hash", "bytes"), "shard-keys")
    rows, size = keys.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    buckets = max(1, math.ceil((size or 0) / bucket_bytes))
    bucket = F.pmod("hash", F.lit(buckets)).cast("int").alias("bucket")
    # Ids and texts whose rows alone would fill a bucket: there are fewer of these than buckets.
    repeated = keys.groupBy("hash").agg(F.sum("bytes").alias("held"), F.count(F.lit(1)).alias("n")).where((F.col("held") > bucket_bytes) & (F.col("n") > 1))
    parts = repeated.select("hash", F.ceil(F.col("held") / bucket_bytes).cast("long").alias("parts"))
    if buckets > 1 and not parts.isEmpty():
        dealt = hashed.join(F.broadcast(parts) if buckets <= broadcast_buckets else parts, "hash", "left")
        turn = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))
        # Written, so that the rows' turns are the same for the counts and for the rows.
        hashed = keys = materialize(dealt.select(F.when(F.col("parts").isNull(), F.col("hash")).otherwise(F.xxhash64("hash", turn)).alias("hash"), "row"), "shard-rows")
    placed = hashed.select("hash", bucket, "row")
    sizes = keys.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    packed = placed.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.collect_list(F.struct("hash", "row")).alias("rows"))
    packed = packed.join(F.broadcast(offsets) if buckets <= broadcast_buckets else offsets, "bucket")
    # Rows of a bucket are sorted first, as the order in which they arrive changes from run to run. Each bucket is a task of its own,
    # and ``shuffle`` starts from the seed and the task's number.
    shuffled = packed.select("before", F.posexplode(F.shuffle(F.array_sort("rows", _by_hash), seed)).alias("at", "item"))
    place = F.col("before") + F.col("at")
    out = shuffled.select("item.row", place.alias("place"))
    shard_of = F.expr(f"cast(place * {n_shards} div {max(1, rows)} as int)")
    # The first place of shard s is the least p with p * n_shards >= s * rows.
    slot = F.expr(f"place - (cast(place * {n_shards} div {max(1, rows)} as int) * {rows}L + {n_shards - 1}) div {n_shards}")
    return out.select(*[F.col("row").getField(c).alias(c) for c in given.columns], shard_of.alias("shard"), slot.alias("slot"))


def _by_hash(a, b):
    x, y = a["hash"], b["hash"]
    return F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(F.lit(0))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard to its own folder ``shard=N`` under ``path``, its files sorted by slot. A bucket lies in a few shards
    at most, so a task writes a few files."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
