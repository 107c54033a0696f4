"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to the floors of scaled Gaussian projections. A query visits its own bucket and perturbed ones in
the order of their estimated success: the least sum of squared distances to the crossed bucket walls first, over all tables. Equal vectors are one entry that keeps its
smallest ids, so copies cost nothing. Buckets meet their queries in blocks of bounded size on both sides, which return the nearest few by exact distance; the merge over
tables keeps the nearest `k`.

Hash sizes, widths and the number of probes are fitted on a bounded sample so that its recall reaches a target. Where no number of probes reaches it, and for single
queries whose buckets hold fewer than `k` others, all entries form one bucket: the same blocks then search exactly.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mix, small_batches, staged


def template(size: int, count: int) -> np.ndarray:
    """Perturbation sets over the ranks of a query's 2 * size wall distances (ascending), at most `count`, the least expected score first.

    The walls of one projection have ranks that add up to 2 * size - 1, and no set holds both. Expected squares are those of order statistics of uniform places.
    """
    m, j = size, np.arange(1, 2 * size + 1)
    i = 2 * m + 1 - j
    expected = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - i / (m + 1) + i * (i + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(float(expected[0]), (0,))] if m else []
    while heap and len(out) < count:
        score, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - x in chosen for x in chosen):
            out.append(chosen)
        last = chosen[-1] + 1
        if last < 2 * m:
            heapq.heappush(heap, (score - expected[last - 1] + expected[last], (*chosen[:-1], last)))
            heapq.heappush(heap, (score + expected[last], (*chosen, last)))
    sets = np.zeros((len(out), 2 * m))
    for n, chosen in enumerate(out):
        sets[n, list(chosen)] = 1
    return sets


class Hashes:
    """The projections of all tables, fitted to the spread of a bounded sample, and the perturbation sets; size 0 puts everything in one bucket."""

    def __init__(self, sample: np.ndarray, tables: int, size: int, width: float, sets: int = 2048, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, size, sample.shape[1]))
        spread = (sample - sample.mean(axis=0)).std() if len(sample) else 1.0
        self.width = width * float(spread) * sample.shape[1] ** 0.5 or 1.0
        self.b = rng.uniform(0, self.width, (tables, size))
        self.sets = template(size, sets)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, size) places in units of cells."""
        return (np.einsum("nd,tmd->ntm", x, self.a, optimize=True) + self.b) / self.width

    @staticmethod
    def keys(floors: np.ndarray, table: np.ndarray) -> np.ndarray:
        """One 64-bit key for floors (..., size) of tables (...)."""
        key = np.zeros(floors.shape[:-1], dtype=np.uint64) + (table.astype(np.uint64) + np.uint64(1))
        for j in range(floors.shape[-1]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + floors[..., j].astype(np.int64).view(np.uint64))
        return key.view(np.int64)

    def bucket_keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the buckets that hold the vectors."""
        floors = np.floor(self.cells(x))
        return self.keys(floors, np.arange(floors.shape[1]))

    def probe_keys(self, x: np.ndarray, count: int) -> np.ndarray:
        """The keys of the `count` most promising buckets of one vector over all tables, the best first."""
        cells = self.cells(x[None])[0]
        tables, size = cells.shape
        floors = np.floor(cells)
        below = cells - floors
        walls = np.concatenate((below, 1 - below), axis=1)  # by table: down each projection, then up
        order = np.argsort(walls, axis=1, kind="stable")
        scores = np.take_along_axis(walls, order, axis=1) ** 2 @ self.sets.T
        flat = scores.reshape(-1)
        count = min(count, len(flat))
        chosen = np.argpartition(flat, count - 1)[:count]
        chosen = chosen[np.lexsort((chosen, flat[chosen]))]
        table, own = chosen // scores.shape[1], chosen % scores.shape[1]
        moved = np.zeros((count, 2 * size))
        np.put_along_axis(moved, order[table], self.sets[own], axis=1)
        return self.keys(floors[table] - moved[:, :size] + moved[:, size:], table)


def ranks_of(hashes: Hashes, sample: np.ndarray, queries: np.ndarray, near: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """For each true neighbour, the number of the first probe that meets it (or a huge one), and the entries met by all probes, per probe and query."""
    keys = hashes.bucket_keys(sample)
    held = np.unique(keys, return_counts=True)
    out, sizes = [], []
    for q, own in zip(queries, near, strict=True):
        probes = hashes.probe_keys(sample[q], 1 << 30)
        first = np.argsort(probes, kind="stable")
        at = np.minimum(np.searchsorted(probes[first], keys[own]), len(probes) - 1)
        hit = probes[first][at] == keys[own]
        out.append(np.where(hit, first[at], 1 << 40).min(axis=1))
        place = np.minimum(np.searchsorted(held[0], probes), len(held[0]) - 1)
        sizes.append(np.where(held[0][place] == probes, held[1][place], 0))
    return np.concatenate(out), np.cumsum(np.mean(sizes, axis=0))


def tuned(sample: np.ndarray, rows: int, k: int, target: float) -> tuple[Hashes, int, float]:
    """Of a few numbers of tables, hash sizes and widths, those that meet the fewest entries at the target recall; their probes and recall on the sample.

    Sizes follow the number of rows. If none reaches the target, one bucket holds everything and the recall is 1.
    """
    step = max(1, len(sample) // 48)
    queries, near = np.arange(0, len(sample), step), []
    for q in queries:
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near.append(np.argsort(d, kind="stable")[: min(k, len(sample) - 1)])
    everything = (Hashes(sample, 1, 0, 1.0), 1, 1.0)
    if not sum(map(len, near)):
        return everything
    best = None
    size = int(min(16, max(4, round(np.log2(max(rows, 2)) / 2.5))))
    for tables, m, width in ((2, size, 2.0), (2, size + 2, 4.0), (4, size, 2.0), (8, size, 2.0), (8, size, 1.0)):
        hashes = Hashes(sample, tables, m, width)
        ranks, met = ranks_of(hashes, sample, queries, near)
        need = int(np.ceil(target * len(ranks))) - 1
        count = int(np.sort(ranks)[need]) + 1 if need < len(ranks) else len(met) + 1
        if count <= len(met):
            cost = float(met[count - 1])
            if best is None or cost < best[0]:
                best = (cost, hashes, count, float((ranks < count).mean()))
    return everything if best is None else best[1:]


def _clean(dim: int, keep: int):
    """Per batch, each distinct usable vector once: (cls, vec, ids), with its `keep` smallest ids."""
    import hashlib

    def run(batches):
        for batch in batches:
            seen: dict[bytes, tuple[list, set]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or len(v) != dim or None in v:
                    continue
                x = np.asarray(v, dtype=np.float64) + 0.0
                if not np.isfinite(x).all() or not x.any():
                    continue
                ids = seen.setdefault(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), (v, set()))[1]
                ids.add(i)
                if len(ids) > keep:
                    ids.discard(max(ids))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v for v, _ in seen.values()], pa.list_(pa.float64())), pa.array([sorted(s) for _, s in seen.values()], pa.list_(pa.int64()))], ["cls", "vec", "ids"])

    return run


def _own_class(dim: int):
    clean = _clean(dim, 1)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for out in clean([batch.slice(i, 1)]):
                    if out.num_rows:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).cast(pa.int64()), out.column(0), out.column(1)], ["query_id", "cls", "vec"])

    return run


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _keyed(hashes: Hashes, count: int | None):
    """(bucket, cls): the buckets that hold each entry, or the `count` that each query visits."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"))
                keys = list(hashes.bucket_keys(x)) if count is None else [hashes.probe_keys(v, count) for v in x]
                at = pa.array(np.repeat(np.arange(len(keys)), [len(v) for v in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("cls").take(at)], ["bucket", "cls"])

    return run


def _nearest(keep: int):
    """Within a block: each query's `keep` nearest entries by exact distance among the buckets it visits, ties to the smaller id."""

    def run(members, queries):
        empty = pa.table({"cls": pa.array([], pa.binary()), "d": pa.array([], pa.float64()), "id": pa.array([], pa.int64())})
        if not len(members) or not len(queries):
            return empty
        members = members.sort_by("bucket")
        bucket, x, ids = members["bucket"].to_numpy(), _matrix(members["vec"]), members["ids"].to_pylist()
        least = np.array([i[0] for i in ids])
        cls, d_out, id_out = [], [], []
        for c, own, q in zip(queries["cls"].to_pylist(), queries["buckets"].to_pylist(), _matrix(queries["vec"]), strict=True):
            own = np.unique(own)
            a, b = np.searchsorted(bucket, own, "left"), np.searchsorted(bucket, own, "right")
            n = b - a
            at = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
            d = np.sqrt(((x[at] - q) ** 2).sum(axis=1))
            if len(at) > keep:
                near = d <= np.partition(d, keep - 1)[keep - 1]
                at, d = at[near], d[near]
            for j in np.lexsort((least[at], d))[:keep]:
                for i in ids[at[j]]:
                    cls.append(c)
                    d_out.append(float(d[j]))
                    id_out.append(i)
        return pa.table({"cls": pa.array(cls, pa.binary()), "d": pa.array(d_out, pa.float64()), "id": pa.array(id_out, pa.int64())})

    return run


def _scan(classes: DataFrame, asked: DataFrame, hashes: Hashes, count: int, keep: int, block: int) -> DataFrame:
    """(cls, d, id): the `keep` nearest (d, id) of each query class among the entries of the buckets that it visits, and their ties.

    A bucket with more than `block` entries or visits is dealt to blocks of its own, small ones share blocks. A vector goes once to each block that needs it; nothing is broadcast.
    """
    members = staged(classes.select("cls", "vec").mapInArrow(_keyed(hashes, None), "bucket long, cls binary"), "members")
    once = asked.groupBy("cls").agg(F.first("vec").alias("vec"))
    visits = staged(once.mapInArrow(_keyed(hashes, count), "bucket long, cls binary"), "visits")
    parts = lambda df, c: df.groupBy("bucket").agg(F.count("*").alias(c))
    shape = parts(members, "m").join(parts(visits, "v"), "bucket")
    total = members.count()
    cut = lambda c: F.ceil(F.col(c) / block).cast("int")
    own = (F.col("m") > block // 2) | (F.col("v") > block // 2)
    shared = F.pmod(F.xxhash64(F.lit(3), "bucket"), F.lit(max(1, total // block)))
    shape = staged(shape.select("bucket", F.when(own, F.col("bucket")).otherwise(shared).alias("block"), F.when(own, cut("m")).otherwise(1).alias("ms"), F.when(own, cut("v")).otherwise(1).alias("vs")), "shape")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    salt = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "cls"), F.col(c)).cast("int")
    left = members.join(shape, "bucket").withColumn("mi", salt(4, "ms")).withColumn("vi", spread("vs")).join(classes, "cls").select(*[F.col(c).alias(f"left_{c}") for c in ("block", "mi", "vi")], "bucket", "vec", "ids")
    right = visits.join(shape, "bucket").withColumn("vi", salt(5, "vs")).withColumn("mi", spread("ms"))
    right = right.groupBy("block", "mi", "vi", "cls").agg(F.collect_list("bucket").alias("buckets")).join(once, "cls")  # a query's buckets in a block: its probes at most
    right = right.select("block", "mi", "vi", "cls", "buckets", "vec")
    found = left.groupBy("left_block", "left_mi", "left_vi").cogroup(right.groupBy("block", "mi", "vi")).applyInArrow(_nearest(keep), "cls binary, d double, id long")
    rank = F.dense_rank().over(Window.partitionBy("cls").orderBy("d", "id"))  # the same entry from several tables has one rank
    best = staged(found.withColumn("rank", rank).where(F.col("rank") <= keep).select("cls", "d", "id").distinct(), "best")
    discard(members, visits, shape)
    return best


def _search(rows: DataFrame, queries: DataFrame, dim: int, k: int, target: float, sample_rows: int, block: int) -> DataFrame | None:
    """The result over the vectors of one dimension; None if no vector is usable."""
    keep = k + 1
    classes = rows.mapInArrow(_clean(dim, keep), "cls binary, vec array<double>, ids array<long>")
    classes = classes.groupBy("cls").agg(F.first("vec").alias("vec"), F.flatten(F.collect_list("ids")).alias("ids"))  # at most `keep` ids a batch
    classes = staged(classes.withColumn("ids", F.slice(F.array_sort(F.array_distinct("ids")), 1, keep)), "classes")
    size = classes.agg(F.count("*").alias("classes"), F.sum(F.size("ids")).alias("ids")).first()
    sample = classes.select("vec", F.xxhash64("cls").alias("h"), "cls").orderBy("h", "cls").limit(sample_rows).select("vec").collect()
    if not sample:
        return None
    sample = np.array([r["vec"] for r in sample], dtype=np.float64)
    hashes, count, recall = tuned(sample, size["classes"], k, target)
    asked = staged(queries.mapInArrow(_own_class(dim), "query_id long, cls binary, vec array<double>"), "queries")
    ranked = F.row_number().over(Window.partitionBy("query_id", "cls").orderBy("d", "id"))

    def answers(who: DataFrame, best: DataFrame) -> DataFrame:
        near = who.select("query_id", "cls").distinct().join(best, "cls").where("id <> query_id")
        return near.withColumn("rank", ranked).where(F.col("rank") <= k)

    near = staged(answers(asked, _scan(classes, asked, hashes, count, keep, block)), "near").withColumn("recall", F.lit(recall))
    if hashes.a.shape[1]:
        few = near.groupBy("query_id", "cls").agg(F.count("*").alias("n"))
        short = asked.join(few, ["query_id", "cls"], "left").where(F.coalesce("n", F.lit(0)) < min(k, max(0, size["ids"] - 1))).drop("n")
        short = staged(short, "short")
        if not short.isEmpty():  # buckets without enough others: these queries meet everything
            exact = answers(short, _scan(classes, short, Hashes(sample, 1, 0, 1.0), 1, keep, block)).withColumn("recall", F.lit(1.0))
            near = near.join(short.select("query_id", "cls").distinct(), ["query_id", "cls"], "left_anti").unionByName(exact)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("d").alias("score"), "recall")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", target: float = 0.99, sample_rows: int = 4000, block: int = 4000) -> DataFrame:
    """(query_id, rank, vec_id, score, recall): each query's k nearest found by Euclidean distance, nearest first, ties to the smaller id.

    Every row of vectors is indexed; a row is no neighbour of the query with its own id. Null, zero, non-finite or null-holding vectors and null ids take no part.
    Vectors of different lengths have no distance, so each length is searched on its own. Rows that repeat an id and a vector count once; other columns are not
    carried, so none can clash. Only the hashes and the number of probes are fitted, on at most sample_rows vectors chosen by a hash, so that their
    recall reaches the target; `recall` is what that sample measured, 1 where the search was exhaustive. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    named = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows, asked = named(vectors), named(queries).distinct()
    dims = sorted(r[0] for r in rows.where("vec IS NOT NULL AND id IS NOT NULL").select(F.size("vec").alias("dim")).distinct().collect())
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, recall double")
    for dim in dims:  # one, as a rule
        of = (lambda df: df.where(F.size("vec") == dim)) if len(dims) > 1 else lambda df: df
        found = _search(of(rows), of(asked), dim, k, target, sample_rows, block) if dim else None
        if found is not None:
            out = found if len(dims) == 1 else out.unionByName(found)
    return out


def op6_ann(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
