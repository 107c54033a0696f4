"""Substring deduplication by level-wise doubling.

A window of `size` words can only be repeated if every shorter window inside it is. Level one hashes windows of length `base`, level two those of
twice that length, and so on to `size`; only positions whose window is repeated go on to the next level. At a level below `size` each size-window is
stood for by its anchor, the inner window of least hash: equal size-windows have equal anchors, so no repeat is lost and about one position in six
moves. Repeats that a task has met are settled there (it keeps the latest in a table of bounded size), so a passage that a third of all documents share
sends about one row a task to its key. The last level marks every window that has an earlier occurrence. Windows are told apart by 128 bits, made of 128-bit
hashes of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, discard, documents, mix, release, runs_of, small_batches, spare, staged, utf8, wide_windows, windows_of, words_of_many

OUT = ("n_words", "n_removed", "kept_text")
HOT = 1 << 17
ANCHORS = "part long, id long, h long, pos int, sure boolean"
MARKS = "part long, k long, id long, h long, pos int, n int, sure boolean"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def level(hashes: np.ndarray, size: int, length: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of windows of `length`, the least of them inside each size-window, and the positions that are some valid window's anchor.

    hashes are those of the words of several texts in a row; valid marks the size-windows that lie in one text (and live).
    """
    inner = windows_of(hashes, length)
    width = size - length + 1
    least = _least(inner, width)
    low = np.where(valid, least, np.uint64(0))
    pad = np.zeros(width - 1, dtype=np.uint64)
    high = ~_least(~np.concatenate((pad, low, pad)), width)
    return inner, least, np.flatnonzero((high == inner) & (inner > 0))


def survivors(inner: np.ndarray, least: np.ndarray, positions: np.ndarray, width: int) -> np.ndarray:
    """Which size-windows have an anchor among the positions."""
    only = np.full(len(inner), np.iinfo(np.uint64).max, dtype=np.uint64)
    only[positions] = inner[positions]
    return _least(only, width) == least


def within(starts: np.ndarray, size: int) -> np.ndarray:
    """Which windows of `size` words lie in one text; starts are the texts' first words, and the number of words."""
    ends = np.repeat(starts[1:], np.diff(starts))
    return np.arange(max(0, len(ends) - size + 1)) + size <= ends[: max(0, len(ends) - size + 1)]


def _unpack(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def _packed(text: str, packed: str, null: str):
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = utf8(batch.column(text))
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([pack.compress(d) if d else None for d in data], pa.binary()), batch.column(text).is_null()], [*names, packed, null])

    return run


def _batch(arrays, names, types):
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names)


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    null = np.array(column.is_null())
    return np.where(null, np.iinfo(np.int64).max, column.fill_null(0).to_numpy()), null


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _positions(batch, a: int, b: int, starts: np.ndarray) -> np.ndarray:
    """The positions given for rows a to b, counted over the words of all of them."""
    own = batch.column("positions").slice(a, b - a)
    return own.flatten().to_numpy().astype(np.int64) + np.repeat(starts[:-1], own.value_lengths().to_numpy())


def _anchor_rows(size: int, lengths: list[int], packed: bool):
    """Emits the anchors at lengths[-1] of the windows that lived through the levels before it (positions given for the last of those)."""
    length = lengths[-1]

    def run(batches):
        hot = np.zeros(0, dtype=np.int64)  # keys that this task has told others are repeated
        for batch in batches:
            ids, _ = _ids(batch.column("id"))
            hs = batch.column("h").to_numpy()
            keys, owner, at = [], [], []
            texts = [_unpack(z) for z in batch.column("text").to_pylist()] if packed else [t or b"" for t in utf8(batch.column("text"))]
            for a, b in runs_of([len(t) for t in texts]):
                hashes, starts = words_of_many(texts[a:b])
                hashes, valid = hashes[:, 0], within(starts, size)
                if not len(valid):
                    continue
                if packed:
                    inner, least, _ = level(hashes, size, lengths[-2], valid)
                    valid &= survivors(inner, least, _positions(batch, a, b, starts), size - lengths[-2] + 1)
                inner, _, chosen = level(hashes, size, length, valid)
                keys.append(inner[chosen])
                own = np.searchsorted(starts, chosen, side="right") - 1
                owner.append(own + a)
                at.append(chosen - starts[own])
            if not keys:
                continue
            keys, owner, at = np.concatenate(keys).view(np.int64), np.concatenate(owner), np.concatenate(at)
            _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
            known = _found(hot, keys)[1]
            sure = known | (count[back] > 1)
            part = np.where(sure, mix((ids[owner].astype(np.uint64) << np.uint64(20)) + at.astype(np.uint64)).view(np.int64), keys)
            flag = np.unique(keys[sure & ~known])  # one row tells other tasks that the key is repeated
            hot = np.union1d(hot, flag) if len(hot) + len(flag) <= HOT else flag
            none = np.zeros(len(flag), dtype=np.int64)
            yield _batch([np.concatenate((part, flag)), np.concatenate((ids[owner], none)), np.concatenate((hs[owner], none)), np.concatenate((at, none - 1)), np.concatenate((sure, none > 0))], ["part", "id", "h", "pos", "sure"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()])
        release()

    return run


def _mark_rows(size: int, length: int):
    """Emits surviving size-windows: those with an earlier one that this task has met as sure runs, the others one by one."""

    def run(batches):
        hot = [np.zeros(0, dtype=np.int64)] * 5  # k1 (sorted), k2, id, h, pos of the first occurrences of windows that this task met more than once
        for batch in batches:
            ids, _ = _ids(batch.column("id"))
            hs = batch.column("h").to_numpy()
            k1, k2, owner, at = [], [], [], []
            texts = [_unpack(z) for z in batch.column("text").to_pylist()]
            for a, b in runs_of([len(t) for t in texts]):
                hashes, starts = words_of_many(texts[a:b])
                valid = within(starts, size)
                if not len(valid):
                    continue
                inner, least, _ = level(hashes[:, 0], size, length, valid)
                found = np.flatnonzero(valid & survivors(inner, least, _positions(batch, a, b, starts), size - length + 1))
                for out, keys in zip((k1, k2), wide_windows(hashes, size), strict=True):
                    out.append(keys[found])
                own = np.searchsorted(starts, found, side="right") - 1
                owner.append(own + a)
                at.append(found - starts[own])
            if not k1:
                continue
            k1, k2, owner, at = np.concatenate(k1).view(np.int64), np.concatenate(k2).view(np.int64), np.concatenate(owner), np.concatenate(at)
            rank = np.empty(len(ids), dtype=np.int64)
            rank[np.lexsort((hs, ids))] = np.arange(len(ids))
            same = np.lexsort((at, rank[owner], k2, k1))
            later = np.zeros(len(at), dtype=bool)
            later[same[1:]] = (k1[same[1:]] == k1[same[:-1]]) & (k2[same[1:]] == k2[same[:-1]])
            # A document that is there twice is one document: equal (id, h, start) is no earlier window.
            twin = np.zeros(len(at), dtype=bool)
            a, b = same[1:], same[:-1]
            twin[a] = later[a] & (ids[owner[a]] == ids[owner[b]]) & (hs[owner[a]] == hs[owner[b]]) & (at[a] == at[b])
            heads = np.zeros(len(at), dtype=bool)  # the first of several equal windows
            heads[b] = later[a] & ~later[b]
            # Equal (id, h, start) are later only where the first of them is.
            group = np.cumsum(~later[same])
            for_same = np.zeros(len(at), dtype=bool)
            for_same[same] = _after_first(group, twin[same])
            later = for_same
            place, met = _found(hot[0], k1)
            if len(hot[0]):
                f_id, f_h, f_pos = (c[place] for c in hot[2:])
                o_id, o_h = ids[owner], hs[owner]
                before = (f_id < o_id) | ((f_id == o_id) & ((f_h < o_h) | ((f_h == o_h) & (f_pos < at))))
                later |= met & (hot[1][place] == k2) & before
            fresh = np.flatnonzero(heads & ~later)
            if len(fresh):
                own = [k1[fresh], k2[fresh], ids[owner[fresh]], hs[owner[fresh]], at[fresh].astype(np.int64)]
                if len(hot[0]) + len(fresh) <= HOT:
                    own = [np.concatenate(c) for c in zip(own, hot, strict=True)]
                hot = [c[np.unique(own[0], return_index=True)[1]] for c in own]  # a new first one stands before the old
            one, many = np.flatnonzero(~later), np.flatnonzero(later)
            cut = np.flatnonzero((np.diff(owner[many]) != 0) | (np.diff(at[many]) != 1)) + 1
            first = many[np.concatenate(([0], cut))] if len(many) else many
            runs = np.diff(np.concatenate(([0], cut, [len(many)]))) if len(many) else many
            spread = mix((ids[owner[first]].astype(np.uint64) << np.uint64(20)) + at[first].astype(np.uint64)).view(np.int64)
            rows = np.concatenate((one, first))
            yield _batch([np.concatenate((k1[one], spread)), np.concatenate((k2[one], np.zeros(len(first), np.int64))), ids[owner[rows]], hs[owner[rows]], at[rows], np.concatenate((np.ones(len(one), np.int64), runs)), np.concatenate((np.zeros(len(one), bool), np.ones(len(first), bool)))], ["part", "k", "id", "h", "pos", "n", "sure"], [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.bool_()])
        release()

    return run


def _after_first(group: np.ndarray, twin: np.ndarray) -> np.ndarray:
    """For rows sorted by group and place: whether a row is later than its group's first place. twin marks rows at the place of the row before."""
    new = np.r_[True, group[1:] != group[:-1]]
    step = np.cumsum(~twin & ~new)  # places begun since the start, but for the groups' first
    return step > np.maximum.accumulate(np.where(new, step, -1))


def _remove(size: int, text: str, names: list[str], z: str, null: str, marks: str):
    def run(batches):
        for batch in batches:
            texts, words, removed, kept = [], [], [], []
            for data, none, runs in zip(*(batch.column(c).to_pylist() for c in (z, null, marks)), strict=True):
                data = _unpack(data) if data else b""
                own = data.split()
                gone = 0
                texts.append(None if none else data)
                words.append(len(own))
                if runs:
                    cover = np.zeros(len(own) + 1, dtype=np.int64)
                    for r in runs:
                        cover[r["pos"]] += 1
                        cover[r["pos"] + r["n"] + size - 1] -= 1
                    stay = np.cumsum(cover[:-1]) == 0
                    gone = len(own) - int(stay.sum())
                    own = [w for w, s in zip(own, stay.tolist(), strict=True) if s]
                removed.append(gone)
                kept.append(b" ".join(own))
            cols = {n: batch.column(n) for n in names if n != text} | {text: pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([cols[n] for n in (*names, *OUT)], [*names, *OUT])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, base: int = 5) -> DataFrame:
    """Every row of docs with n_words, n_removed and kept_text: the words that no repeated window covers, joined by one space.

    A word goes when a window of `size` words covers it whose word sequence also starts earlier: in a smaller id, or earlier in the same document. Windows
    are judged on the input. Words are runs of bytes other than ASCII white space. Null and wordless texts have no words. Rows that repeat
    an id and a text are one document; rows that repeat an id with other texts are ordered by a hash of the text; null ids come last. Input columns that bear an
    output's name are replaced; all others stay, whatever their names. An empty table gives no rows. base, doubled, has to reach size exactly.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*OUT)
    lengths = [base]
    while 2 * lengths[-1] < size:
        lengths.append(2 * lengths[-1])
    if 2 * lengths[-1] != size:
        raise ValueError("base must reach size by doubling")
    names = docs.columns
    own_hash, z, null, runs, own_id, mark_id, mark_hash = (spare(names, f"__{n}") for n in ("hash", "packed", "null", "marks", "own", "id", "of"))
    rows = docs.withColumns({own_hash: F.xxhash64(text_col), own_id: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))})
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(own_hash).alias("h"), F.col(text_col).alias("text"))
    fields = [f for f in rows.schema.fields if f.name != text_col]
    packed = rows.mapInArrow(_packed(text_col, z, null), T.StructType([*fields, T.StructField(z, T.BinaryType()), T.StructField(null, T.BooleanType())]))
    # The texts are dealt by (id, hash) once; the joins of all levels find them there.
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    packed = bucketed(packed, "substring-texts", (own_id, own_hash), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (64 << 20))))
    small = packed.select(F.col(own_id).alias("id"), F.col(own_hash).alias("h"), F.col(z).alias("text"))
    alive = None
    for k in range(len(lengths)):
        if alive is None:
            anchors = plain.mapInArrow(_anchor_rows(size, lengths[:1], False), ANCHORS)
        else:
            anchors = small.join(alive, ["id", "h"]).mapInArrow(_anchor_rows(size, lengths[: k + 1], True), ANCHORS)
        counted = anchors.withColumn("seen", F.count("*").over(Window.partitionBy("part")))
        before, alive = alive, counted.where("pos >= 0 AND (sure OR seen > 1)").groupBy("id", "h").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
        alive = staged(alive, f"level-{lengths[k]}")
        if before is not None:
            discard(before)
    marks = small.join(alive, ["id", "h"]).mapInArrow(_mark_rows(size, lengths[-1]), MARKS)
    first = Window.partitionBy("part", "k", "sure").orderBy("id", "h", "pos")
    marks = marks.withColumn("rank", F.rank().over(first)).where("sure OR rank > 1").groupBy("id", "h").agg(F.collect_list(F.struct("pos", "n")).alias(runs))
    marks = staged(marks, "marks").select(F.col("id").alias(mark_id), F.col("h").alias(mark_hash), runs)
    discard(alive)
    joined = packed.join(marks, (F.col(own_id) == F.col(mark_id)) & (F.col(own_hash) == F.col(mark_hash)), "left").drop(own_id, mark_id, mark_hash, own_hash)
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_remove(size, text_col, names, z, null, runs), out)


def op4_substring_dedup(spark, sf_dir):
    out = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM s),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM m),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(p.word, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i WHERE c.i IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(g.n_kept, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
