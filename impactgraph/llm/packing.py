"""Best-fit packing by linear grouping.

Token counts are at most `capacity`, so the whole corpus is described by a histogram of bounded size. From it the driver plans runs of equal sequences:
large lengths are cut, largest first, into groups of equal cardinality and rounded up to each group's largest length; the few sizes
give a configuration programme that column generation solves; actual lengths take the places of the rounded ones; what is left, and then all small
lengths, go best-fit in decreasing order into the space that remains. The plan has a number of rows that depends on the capacity only. On the
executors a piece looks up its place from its length and its rank among the pieces of that length; ranks come from
(length, salt) groups of bounded size, so a length that a third of all pieces share is no bottleneck.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, release, small_batches, staged
from .encoding import default_path, encoder

SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


def _grouped(runs: list[tuple[int, int]], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, runs of actual lengths) of groups of equal cardinality; runs are (length, count), largest first."""
    total = sum(n for _, n in runs)
    per, out, room = -(-total // groups), [], 0
    for length, n in runs:
        while n:
            if not room:
                out.append((length, []))
                room = per
            take = min(n, room)
            out[-1][1].append([length, take])
            n, room = n - take, room - take
    merged: list[tuple[int, list[list[int]]]] = []
    for size, own in out:  # groups that round to one size are one
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(own)
        else:
            merged.append((size, own))
    return merged


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity, by a layered knapsack over the number of items."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        nxt, pick = best.copy(), np.full(capacity + 1, -1)
        for k, s in enumerate(sizes):
            with_k = np.full(capacity + 1, -1.0)
            with_k[s:] = best[: capacity + 1 - s] + values[k]
            better = with_k > nxt + 1e-12
            nxt[better], pick[better] = with_k[better], k
        picks.append(pick)
        if (pick < 0).all():
            break
        best = nxt
    counts, c = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of configurations from the programme min sum(x), A x = demand, rounded down; A's columns are priced in."""
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * len(sizes)):
        value, column = _best_configuration(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), capacity)
        if value <= 1 + 1e-9:
            break
        x, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, demand)
    return [(int(np.floor(n + 1e-9)), basis[:, j].astype(int)) for j, n in enumerate(x) if n >= 1 - 1e-9]


def plan(histogram: dict[int, int], capacity: int = 2048, small: float = 0.125, groups: int = 64) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (number of sequences, [(length, copies in each)]) that hold every length of the histogram exactly as often as it occurs."""
    runs = sorted(((n, c) for n, c in histogram.items() if c > 0), reverse=True)
    large = [r for r in runs if r[0] > small * capacity]
    rest = {n: c for n, c in runs if n <= small * capacity}
    bins: dict[int, list] = {}
    spaces: list[int] = []

    def put(space, many, items):
        if not many:
            return
        if space not in bins:
            bins[space] = []
            insort(spaces, space)
        bins[space].append((many, items))

    if large:
        grouped = _grouped(large, groups)
        sizes, demand = np.array([s for s, _ in grouped]), np.array([float(sum(n for _, n in own)) for _, own in grouped])
        for many, counts in configurations(sizes, demand, capacity):
            slots = [k for k, a in enumerate(counts) for _ in range(a)]
            taken = []
            for k in slots:  # the actual lengths of group k, largest first
                own, need, got = grouped[k][1], many, []
                while need:
                    take = min(need, own[0][1])
                    got.append([own[0][0], take])
                    own[0][1] -= take
                    need -= take
                    if not own[0][1]:
                        own.pop(0)
                taken.append(got)
            while many:
                step = min(t[0][1] for t in taken)
                items: dict[int, int] = {}
                for t in taken:
                    items[t[0][0]] = items.get(t[0][0], 0) + 1
                    t[0][1] -= step
                    if not t[0][1]:
                        t.pop(0)
                put(capacity - sum(n * q for n, q in items.items()), step, list(items.items()))
                many -= step
        for _, own in grouped:
            for n, c in own:
                rest[n] = rest.get(n, 0) + c
    for length, left in sorted(rest.items(), reverse=True):
        while left:
            i = bisect_left(spaces, length)
            if i == len(spaces):
                space, (many, items) = capacity, (-(-left // (capacity // length)), [])
            else:
                space = spaces[i]
                many, items = bins[space].pop()
                if not bins[space]:
                    del bins[space]
                    spaces.pop(i)
            q = space // length
            full = min(many, left // q)
            part = left % q if full < many and left // q == full else 0
            put(space - q * length, full, [*items, (length, q)])
            if part:
                put(space - part * length, 1, [*items, (length, part)])
            if items:
                put(space, many - full - bool(part), items)
            left -= full * q + part
    return [run for space in spaces for run in bins[space]]


def best_plan(histogram: dict[int, int], capacity: int = 2048, smalls: tuple[float, ...] = (0.125, 0.25, 0.34, 0.42, 0.5)) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan with the fewest sequences over several bounds between small and large lengths; planning costs no pass over the data."""
    return min((plan(histogram, capacity, small) for small in smalls), key=lambda runs: sum(many for many, _ in runs))


def places(runs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """(length, first rank, copies, first sequence, offset) for each length of each run, sorted for lookup."""
    rows, used, sequence = [], {}, 0
    for many, items in runs:
        offset = 0
        for length, q in items:
            rows.append((length, used.get(length, 0), q, sequence, offset))
            used[length] = used.get(length, 0) + many * q
            offset += length * q
        sequence += many
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = [[], [], [], [], []]
            for d, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1 if piece == 0 else capacity
                    for col, v in zip(out, (d, piece, at, size, ids[4 * at : 4 * (at + size)]), strict=True):
                        col.append(v)
                    at, piece = at + size, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])
        release()

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", rank_rows: int = 20_000) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32, sequence_id, offset.

    Each document's ids end with end_id; a null text is empty and gives the end id alone. A document over the capacity is cut into full pieces, the first one
    shorter. Rows that repeat an id are documents of their own; a null id stays null. Other columns are not carried. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(rows.mapInArrow(_cut(path or default_path(), end_id, capacity), SCHEMA), "pieces").withColumn("ids_crc32", F.crc32("ids"))
    counted = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counted.collect()}  # at most `capacity` rows
    table = places(best_plan(histogram, capacity))
    top = 1 << 42
    keys = table[:, 0] * top + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        row = table[np.searchsorted(keys, length * top + rank, side="right") - 1]
        at = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + at // row[:, 2], "offset": row[:, 4] + at % row[:, 2] * length})

    # Salts: a length with n pieces has n / rank_rows groups.
    salts = spark.createDataFrame([(n, -(-c // rank_rows)) for n, c in histogram.items()] or [(0, 1)], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(groups.select("length", "salt", before.alias("before")), ["length", "salt"])
    out = ranked.withColumn("at", place("length", F.col("before") + F.col("within")))
    return out.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<long>): each packed sequence's ids in order; a sequence holds at most the capacity."""
    out = "sequence_id long, ids array<long>"

    def join(key, table):
        table = table.sort_by("offset")
        return pa.table({"sequence_id": [key[0].as_py()], "ids": pa.array([np.frombuffer(b"".join(table["ids"].to_pylist()), "<u4").astype(np.int64)], pa.list_(pa.int64()))})

    return packed.groupBy("sequence_id").applyInArrow(join, out)


def op10_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir)).drop("ids")
