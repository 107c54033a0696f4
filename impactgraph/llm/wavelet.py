"""Token ids on disk as wavelet matrices: succinct bit-planes with rank and select, one compressed row a shard.

File format: Parquet, rows (part, shard, n, before, ids, valid, ends, planes). A shard is a run of documents in ascending id order, and part and shard order the
shards; before counts the ids of the part before the shard. `ids`, `valid` and `ends` are its documents' ids, whether they are not null, and their ends as token counts. `planes` holds, from the highest bit
down, (plane, zeros, bits, ranks): the packed bits of every id in the order left by the planes above (zeros first, stable), the ones before
each block of 512 bits, and the number of zeros. From these alone a reader gets the id at a place, the count of an id, and the place of an id's k-th
occurrence: `access`, `count` and `locate` answer over the written table, `WaveletMatrix` within one shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, small_batches, staged
from .encoding import default_path, encoder

BLOCK = 512
SCHEMA = "part int, shard int, n long, before long, ids binary, valid binary, ends binary, planes array<struct<plane:int,zeros:long,bits:binary,ranks:binary>>"


def build(ids: np.ndarray, planes: int) -> list[tuple[int, int, bytes, bytes]]:
    """(plane, zeros, bits, ranks) of each bit-plane, the highest first. An id that does not fit raises ValueError."""
    out, n = [], len(ids)
    if n and int(ids.max()) >> planes:
        raise ValueError(f"id {int(ids.max())} does not fit in {planes} bits")
    ids = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for p in range(planes - 1, -1, -1):
        bit = (ids & ids.dtype.type(1 << p)) != 0
        packed = np.packbits(bit, bitorder="little")
        words = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
        words[: len(packed)] = packed
        ones = np.bitwise_count(words.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate(([0], np.cumsum(ones))).astype("<u4")
        zeros = n - int(ranks[-1])
        out.append((p, zeros, packed.tobytes(), ranks.tobytes()))
        after = np.empty_like(ids)
        np.compress(~bit, ids, out=after[:zeros])
        np.compress(bit, ids, out=after[zeros:])
        ids = after
    return out


class WaveletMatrix:
    """Reads one shard from its planes: access, rank (count) and select (occurrence lookup)."""

    def __init__(self, planes: list[tuple[int, int, bytes, bytes]], n: int):
        self.n = n
        self.planes = [(p, z, np.frombuffer(b, np.uint8), np.frombuffer(r, "<u4")) for p, z, b, r in sorted(planes, reverse=True, key=lambda x: x[0])]

    def _ones(self, bits, ranks, i: int) -> int:
        block = i // BLOCK
        rest = np.unpackbits(bits[block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(ranks[block]) + int(rest.sum())

    def access(self, i: int) -> int:
        value = 0
        for p, zeros, bits, ranks in self.planes:
            one = (int(bits[i >> 3]) >> (i & 7)) & 1
            value |= one << p
            ones = self._ones(bits, ranks, i)
            i = zeros + ones if one else i - ones
        return value

    def _descend(self, value: int, i: int) -> tuple[int, int]:
        start = 0
        for p, zeros, bits, ranks in self.planes:
            a, b = self._ones(bits, ranks, start), self._ones(bits, ranks, i)
            start, i = (zeros + a, zeros + b) if (value >> p) & 1 else (start - a, i - b)
        return start, i

    def count(self, value: int, end: int | None = None) -> int:
        """Occurrences of value among the first `end` ids (all by default)."""
        if value < 0 or value >> len(self.planes):
            return 0
        start, stop = self._descend(value, self.n if end is None else end)
        return stop - start

    def locate(self, value: int, k: int) -> int | None:
        """The place of the k-th occurrence of value, from 0; None if there are fewer."""
        if k < 0 or k >= self.count(value):
            return None
        i = self._descend(value, 0)[0] + k
        for p, zeros, bits, ranks in reversed(self.planes):
            one = (value >> p) & 1
            k = i - zeros if one else i
            ones = ranks if one else np.arange(len(ranks)) * BLOCK - ranks.astype(np.int64)
            block = int(np.searchsorted(ones[:-1], k, side="right")) - 1
            inside = np.unpackbits(bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
            i = block * BLOCK + int(np.flatnonzero(inside == one)[k - int(ones[block])])
        return i

    def all(self) -> np.ndarray:
        """Every id in order, by undoing the stable partitions from the lowest plane up."""
        ids = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for p, zeros, bits, _ in reversed(self.planes):
            ids[zeros:] |= ids.dtype.type(1 << p)
            bit, above = np.unpackbits(bits, count=self.n, bitorder="little").view(bool), np.empty_like(ids)
            above[np.flatnonzero(bit)] = ids[zeros:]
            above[np.flatnonzero(~bit)] = ids[:zeros]
            ids = above
        return ids.astype(np.uint32)


KIND = pa.list_(pa.struct([("plane", pa.int32()), ("zeros", pa.int64()), ("bits", pa.binary()), ("ranks", pa.binary())]))


def _row(part: int, shard: int, before: int, ids: list[bytes], doc_ids: list, planes: int) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    docs = pa.array(doc_ids, pa.int64())
    cols = {
        "part": pa.array([part], pa.int32()),
        "shard": pa.array([shard], pa.int32()),
        "n": pa.array([len(flat)], pa.int64()),
        "before": pa.array([before], pa.int64()),
        "ids": pa.array([docs.fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
        "valid": pa.array([np.array([d is not None for d in doc_ids], dtype=bool).tobytes()], pa.binary()),
        "ends": pa.array([np.cumsum([len(x) // 4 for x in ids]).astype("<i8").tobytes()], pa.binary()),
        "planes": pa.array([[dict(zip(("plane", "zeros", "bits", "ranks"), p, strict=True)) for p in build(flat, planes)]], KIND),
    }
    return pa.RecordBatch.from_pydict(cols)


def _write(path: str, end_id: int, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder(path), np.array([end_id], "<u4").tobytes()
        planes = max(end_id, enc.tokenizer.get_vocab_size(with_added_tokens=True) - 1, 1).bit_length()
        held, docs, size, shard, before = [], [], 0, 0, 0
        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                held.append(ids + end)
                docs.append(d)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield _row(part, shard, before, held, docs, planes)
                    held, docs, size, shard, before = [], [], 0, shard + 1, before + size
        if docs:
            yield _row(part, shard, before, held, docs, planes)

    return run


def write_wavelets(docs: DataFrame, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 17, part_bytes: int = 32 << 20) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes wavelet matrices in ascending id order; returns the table of files.

    A null text is empty, so its document holds the end id alone. Repeated ids stay apart, ordered by a hash of their
    texts; null ids come first. Ranges follow (id, hash), so one id with a third of all rows still spreads. The number of planes follows from the tokenizer's
    size. Other columns are not carried, so none can clash. A shard ends with the document that reaches shard_tokens; an empty table has no shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = rows.repartitionByRange(int(max(1, -(-total // part_bytes))), "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    return staged(ranged.mapInArrow(_write(path or default_path(), end_id, shard_tokens), SCHEMA), "wavelet")


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix([(p["plane"], p["zeros"], p["bits"], p["ranks"]) for p in row["planes"]], row["n"])


def _documents(batches):
    """Shards to their documents, decoded from the planes."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, docs, ends = _matrix(row).all().astype("<u4", copy=False), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i8")
            starts, size = np.concatenate(([0], ends[:-1])), len(docs)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            cols = [pa.array([row["part"]] * size, pa.int32()), pa.array(docs, pa.int64(), mask=~np.frombuffer(row["valid"], dtype=bool)), pa.array(starts + row["before"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "local", "n_tokens", "ids_crc32"])


def _before(window, column: str):
    """The sum of a column over the window's rows before the current one."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _bases(shards: DataFrame) -> DataFrame:
    """(part, base): the sum of n over all parts before. Parts are summed first, so the last step has one row a part in its only task."""
    parts = shards.groupBy("part").agg(F.sum("n").alias("total"))
    return parts.select("part", _before(Window.orderBy("part"), "total").alias("base"))


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the wavelet files alone; planes are decoded where they are read."""
    docs = files.mapInArrow(_documents, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(_bases(files.select("part", "n")), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def access(files: DataFrame, places: list[int]) -> DataFrame:
    """(place, id) of the ids at places counted over the whole table; places outside it give no row. The places are the caller's list; shards without any are not read."""
    places = sorted(set(places))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = _matrix(row)
                own = [p for p in places if row["before"] <= p < row["before"] + row["n"]]
                yield pa.RecordBatch.from_pydict({"place": pa.array(own, pa.int64()), "id": pa.array([matrix.access(p - row["before"]) for p in own], pa.int64())})

    starts = files.select("part", "shard", "n", "before").join(_bases(files.select("part", "n")), "part").withColumn("before", F.col("base") + F.col("before"))
    hit = F.exists(F.lit(places).cast("array<long>"), lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n")))
    wanted = starts.where(hit).select("part", "shard", "before")
    return files.drop("before").join(wanted, ["part", "shard"]).select("part", "shard", "n", "before", "planes").mapInArrow(run, "place long, id long")


def _counts(values: list[int]):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = _matrix(row)
                found = [matrix.count(v) for v in values]
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * len(values), pa.int32()), "shard": pa.array([row["shard"]] * len(values), pa.int32()), "id": pa.array(values, pa.int64()), "n": pa.array(found, pa.int64())})

    return run


def count(files: DataFrame, values: list[int]) -> DataFrame:
    """(id, n): how often each of the ids occurs in the whole table, by rank queries on each shard."""
    found = files.select("part", "shard", "n", "planes").mapInArrow(_counts(sorted(set(values))), "part int, shard int, id long, n long")
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def locate(files: DataFrame, value: int, k: int) -> int | None:
    """The place, over the whole table, of an id's k-th occurrence from 0; None if there are fewer. One shard's planes are selected on."""
    found = staged(files.select("part", "shard", "n", "planes").mapInArrow(_counts([value]), "part int, shard int, id long, n long"), "occurrences")
    inner = _before(Window.partitionBy("part").orderBy("shard"), "n")
    earlier = found.withColumn("inner", inner).join(_bases(found), "part").withColumn("earlier", F.col("base") + F.col("inner"))
    at = earlier.where((F.col("earlier") <= k) & (F.col("earlier") + F.col("n") > k)).select("part", "shard", "earlier").first()
    discard(found)
    if at is None or k < 0:
        return None
    row = files.where((F.col("part") == at["part"]) & (F.col("shard") == at["shard"])).first().asDict(True)
    base = _bases(files.select("part", "n")).where(F.col("part") == at["part"]).first()["base"]
    return base + row["before"] + _matrix(row).locate(value, k - at["earlier"])


def op2_wavelet(spark, sf_dir):
    return read_documents(write_wavelets(documents(spark, sf_dir)))
