"""Sharding by a two-pass external shuffle.

Pass one scatters every record by seeded hashes into buckets that fit in memory; pass two shuffles each bucket with
Fisher-Yates and writes it. The shard is a jump consistent hash of the record's key, so one more shard takes records only into
itself (law `key`). Within a shard the bucket is a seeded hash of the whole record, so one hot key spreads over the shard's
buckets. All random choices follow from seeds and contents: a task that is run again writes the same file.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches, spare, staged

OUT = ("size", "law", "shard", "grown_shard", "bucket", "slot", "text_crc32")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys: the shard of each, from 0."""
    keys = keys.astype(np.uint64)
    found, nxt = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.float64)
    live = np.arange(len(keys))
    while len(live):
        found[live] = nxt[live].astype(np.int64)
        keys[live] = keys[live] * np.uint64(2862933555777941757) + np.uint64(1)
        nxt[live] = np.floor((found[live] + 1) * (float(1 << 31) / ((keys[live] >> np.uint64(33)).astype(np.float64) + 1)))
        live = live[nxt[live] < shards]
    return found


def fisher_yates(order: np.random.Generator, n: int) -> np.ndarray:
    """A permutation of 0..n-1 by the Fisher-Yates exchange (numpy's shuffle is that algorithm)."""
    at = np.arange(n)
    order.shuffle(at)
    return at


def _shuffled(schema: pa.Schema, seed: int, chunk_bytes: int, pos: str):
    def run(batches):
        held, size, now, base, chunk = [], 0, None, 0, 0

        def emit():
            nonlocal held, size, base, chunk
            table = pa.Table.from_batches(held)
            at = fisher_yates(np.random.default_rng([seed, *now, chunk]), len(table))
            table = table.take(pa.array(at)).append_column(pos, pa.array(np.arange(base, base + len(at)), pa.int64()))
            base, chunk, held, size = base + len(at), chunk + 1, [], 0
            yield from table.select(schema.names).cast(schema).to_batches(max_chunksize=2048)

        for batch in batches:
            shard, bucket = batch.column("shard").to_numpy(), batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(bucket) != 0)) + 1), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key = (int(shard[a]), int(bucket[a]))
                if now != key or size > chunk_bytes:
                    if held:
                        yield from emit()
                    if now != key:
                        now, base, chunk = key, 0, 0
                held.append(batch.slice(a, b - a))
                size += held[-1].nbytes
        if held:
            yield from emit()

    return run


def shard(df: DataFrame, shards: int, key: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Writes df as shuffled shard files in the shared folder and returns them as a table read back from those files.

    Added columns: size (UTF-8 bytes of the text, none for null, plus 16), law, shard, grown_shard (with one more shard),
    bucket, text_crc32 (of the text as the file has it) and slot (the record's place in its shard, gapless from 0). Null keys count as a key of their own; repeated rows are
    separate records. Rows that are equal in all columns share a bucket; one that outgrows four times bucket_bytes is shuffled in runs of that
    size, so memory stays bounded; rows come to it in the order of the hash of their contents, which is uniform, so the runs are uniform parts of the bucket. Input
    columns that bear an output's name are replaced, all others stay. An empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = df.drop(*OUT)
    pos, order_hash, before_ = (spare(df.columns, f"__{n}") for n in ("pos", "order", "before"))
    df = df.withColumn("size", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16)
    total = df.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))

    def jumps(n):
        @F.pandas_udf("int")
        def at(keys: pd.Series) -> pd.Series:
            return pd.Series(jump(keys.to_numpy().view(np.uint64).copy(), n).astype(np.int32))

        return at

    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    hashed = F.xxhash64(F.lit(seed), F.col(key))
    scattered = df.withColumns({"shard": jumps(shards)(hashed), "grown_shard": jumps(shards + 1)(hashed), order_hash: F.xxhash64(F.lit(seed + 1), *[F.col(c) for c in plain])})
    scattered = scattered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 2), order_hash), F.lit(per_shard)).cast("long"))
    scattered = scattered.repartitionById(int(shards * per_shard), (F.col("shard") * per_shard + F.col("bucket")).cast("int")).sortWithinPartitions("shard", "bucket", order_hash, key).drop(order_hash)
    out = T.StructType([*scattered.schema.fields, T.StructField(pos, T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    written = staged(scattered.mapInArrow(_shuffled(to_arrow_schema(out), seed, 4 * bucket_bytes, pos), out), "shards")
    written = written.withColumn("text_crc32", F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    written = written.join(counts.select("shard", "bucket", before.alias(before_)), ["shard", "bucket"])
    return written.withColumns({"slot": F.col(before_) + F.col(pos), "law": F.lit("key")}).drop(before_, pos)


def op1_sharding(spark, sf_dir):
    out = shard(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
