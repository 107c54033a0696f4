"""Near-duplicates by b-bit MinHash.

Documents with equal shingle sets form a class, so a group of copies is one node however large it is. Bands of full
minima give candidates; the low bits of all minima, packed into one binary, estimate each candidate's similarity, corrected for chance collisions, by counting equal
positions; whole sets confirm what the estimate leaves. No bucket emits its pairs: every node meets its least hub
first. In a bucket that still holds several components, the members outside its largest one meet all others in blocks of bounded size: signatures first,
which leave a list of members, then the texts of those alone, which give joining links.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, mix, packed, release, runs_of, small_batches, staged, unpacked, utf8, windows_of, words_of, words_of_many

PERMUTATIONS, ROWS, BITS = 128, 4, 8
_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64)).astype(np.uint32)
SETS = "doc_id long, n_shingles long, node long, twin long, sig binary, bands array<long>, text_hash binary"


def shingle_set(text: str | bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    hashes = words_of(text if isinstance(text, bytes) else (text or "").encode(), lower=True)[:, 0]
    if not len(hashes):
        return hashes
    return np.unique(windows_of(hashes, min(size, len(hashes)), seed=0 if len(hashes) >= size else len(hashes)))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """shingle_set of each text; words and windows of all are hashed at once."""
    hashes, starts = words_of_many(texts, lower=True)
    hashes = hashes[:, 0]
    windows, out = windows_of(hashes, size), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = windows[a : b - size + 1] if b - a >= size else windows_of(hashes[a:b], b - a, seed=b - a) if b > a else hashes[:0]
        out.append(np.unique(own))
    return out


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the set (BLAKE2b) in two halves: the first names a class, the second tells classes of one name apart."""
    return struct.unpack("<qq", hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each permutation x -> a x + b of 32-bit values."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (_A[:, None] * x[None, i : i + 2048] + _B[:, None]).min(axis=1), out=out)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (uint8 rows), corrected for the 2**-BITS chance of equal low bits."""
    chance = 2.0**-BITS
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def hash_of(text_col: str):
    """SHA-256 of a text; null for a null text."""
    return F.unhex(F.sha2(text_col, 256))


def _sets(batches):
    for batch in batches:
        n, nodes, twins, sigs, bands = [], [], [], [], []
        texts = [t or b"" for t in utf8(batch.column("text"))]
        for s in (s for a, b in runs_of([len(t) for t in texts]) for s in shingle_sets(texts[a:b])):
            n.append(len(s))
            if not len(s):
                for c in (nodes, twins, sigs, bands):
                    c.append(None)
                continue
            m = minima(s)
            node, twin = node_of(s)
            nodes.append(node), twins.append(twin)
            sigs.append((m & np.uint32((1 << BITS) - 1)).astype(np.uint8).tobytes())
            rows = m.reshape(-1, ROWS).astype(np.uint64)
            key = np.arange(1, len(rows) + 1, dtype=np.uint64)
            for j in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
            bands.append(key.view(np.int64))
        cols = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(twins, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column("text_hash")]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "node", "twin", "sig", "bands", "text_hash"])
    release()


def _linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(a) + len(b) - both)


def _confirm(threshold: int):
    def run(batches):
        hub, hub_set = None, None
        for batch in batches:
            a, b = [], []
            for h, node, role, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "node", "role", "text")), strict=True):
                own = shingle_set(unpacked(text))
                if role == 0:
                    hub, hub_set = h, own
                elif hub == h and _linked(hub_set, own, threshold):
                    a.append(h)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int, name: str, salt_rows: int = 500) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. a is the hub; its members are salted into groups of bounded size."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts"))
    salted = pairs.join(salts, "a")
    members = salted.select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
    hubs = salts.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("node"))
    rows = texts.join(members.unionByName(hubs), "node").select("hub", "salt", "role", "node", "text")
    return staged(rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "node").mapInArrow(_confirm(threshold), "a long, b long").distinct(), name)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b), by label minima and pointer jumping."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("near"))
        least = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        nxt = staged(least.join(jump, "comp").select("node", "was", F.least("comp", "far").alias("comp")), "labels")
        labels = nxt.select("node", "comp")
        if nxt.where("was <> comp").isEmpty():
            return labels


def joined(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """comps after more edges: only the graph of the components that these touch is searched."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    ends = staged(ends.where("a <> b").distinct(), "links")
    if ends.isEmpty():
        return comps
    moved = components(ends).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    known = comps.unionByName(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps, "node", "left_anti").select("node", F.col("node").alias("comp")))
    return staged(known.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "comps")


class _Block:
    """One block of a bucket: some members outside its largest component (left) against some of all members (right).

    Only pairs of different components count, in the first band that both share, and once though both may be on the left.
    """

    def __init__(self, table, floor: float, threshold: int):
        self.t = t = table.to_pydict()
        self.node, self.comp, self.n, side = (np.array(t[c], dtype=np.int64) for c in ("node", "comp", "n", "side"))
        minor = np.array(t["minor"], dtype=bool)
        sig = np.frombuffer(b"".join(t["sig"]), np.uint8).reshape(len(self.node), -1)
        bands = np.array(t["bands"], dtype=np.int64)
        here = int(np.flatnonzero((bands == t["band"][0]).all(axis=0))[0])
        right = np.flatnonzero(side == 1)
        self.pairs: list[tuple[float, int, int]] = []
        for i in np.flatnonzero(side == 0):
            low, high = np.minimum(self.n[right], self.n[i]), np.maximum(self.n[right], self.n[i])
            ok = right[(self.comp[right] != self.comp[i]) & (100 * low >= threshold * high) & (~minor[right] | (self.node[right] > self.node[i]))]
            if here and len(ok):
                ok = ok[~(bands[ok, :here] == bands[i, :here]).any(axis=1)]
            if len(ok):
                e = estimate(sig[ok], sig[i])
                self.pairs += [(-float(x), int(i), int(j)) for x, j in zip(e[e >= floor], ok[e >= floor], strict=True)]


def _similar(floor: float, threshold: int):
    """The members of a block that have a pair whose estimate reaches the floor: a row a member at most, and no texts."""

    def run(table):
        block = _Block(table, floor, threshold)
        at = np.unique([x for _, i, j in block.pairs for x in (i, j)]).astype(np.int64)
        nodes = np.unique(block.node[at])
        return pa.table({"band": pa.array(np.full(len(nodes), block.t["band"][0]), pa.int64()), "node": pa.array(nodes, pa.int64())})

    return run


def _across(floor: float, threshold: int):
    """Links that join members of different components, most similar pairs first, confirmed on whole sets.

    Pairs that links found here have joined already need no test, so a block gives fewer links than it has members.
    """

    def run(table):
        block = _Block(table, floor, threshold)
        home = {c: c for c in block.comp.tolist()}

        def find(c):
            while home[c] != c:
                home[c] = c = home[home[c]]
            return c

        sets: dict[int, np.ndarray] = {}

        def own(i):
            if i not in sets:
                sets[i] = shingle_set(unpacked(block.t["text"][i]))
            return sets[i]

        a, b = [], []
        for _, i, j in sorted(block.pairs):
            x, y = find(int(block.comp[i])), find(int(block.comp[j]))
            if x != y and _linked(own(i), own(j), threshold):
                home[max(x, y)] = min(x, y)
                a.append(int(block.node[i]))
                b.append(int(block.node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def blocked(rows: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """rows (band, node, comp, minor, ...) dealt to blocks (band, lo, hi): the minor ones on the left in lo, all on the right in hi.

    A block side has about `block` rows and, where rows bear texts, about block_bytes of them, so its memory is bounded whatever the bucket's size.
    Only minor members meet all others: members of a bucket's largest component never meet each other.
    """
    size = F.length("text") if "text" in rows.columns else F.lit(0)
    parts = lambda n, b: F.greatest(F.lit(1), F.ceil(F.sum(n) / block), F.ceil(F.sum(b) / block_bytes)).cast("int")
    one = F.col("minor").cast("int")
    sizes = rows.groupBy("band").agg(parts(one, one * size).alias("los"), parts(F.lit(1), size).alias("his"))
    rows = rows.join(sizes, "band")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(c)).cast("int")
    left = rows.where("minor").withColumns({"side": F.lit(0), "lo": place("los", 1)}).withColumn("hi", spread("his"))
    right = rows.withColumns({"side": F.lit(1), "hi": place("his", 2)}).withColumn("lo", spread("los"))
    return left.unionByName(right).drop("los", "his")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75, floor: float = 0.58, block: int = 1000, text_hash: str | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: its near-duplicate component; text_hash names a column for hash_of the row's text.

    Two documents are linked when 100 * intersection >= threshold * union of their sets of distinct 5-word shingles (A-Z lower-cased). component_id is
    the smallest id reachable; kept marks the row with that id. Null or wordless texts have an empty set, link with nothing and are kept. Repeated
    rows are members of one class; null ids rank behind all others. An empty table gives no rows; other columns are not carried, so none can clash. A pair is a candidate when one of 32 bands of 4
    minima agrees (at the threshold a pair is missed once in 190,000) and its estimate reaches `floor`, 4.5 standard deviations under it.
    Shingles are told apart by 64 bits made of 128-bit word hashes, sets by 128 bits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", hash_of("text"))
    sets = staged(source.mapInArrow(_sets, SETS), "sets")
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    classes = sets.where("node IS NOT NULL").groupBy("node", "twin").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", last).alias("rep_hash"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    alike = classes.groupBy("node").agg(F.min("twin").alias("first"), F.count("*").alias("many")).where("many > 1").select("node", "first")
    if not alike.isEmpty():  # different sets of one 64-bit name: all but one get new names
        apart = F.when(F.col("twin") != F.col("first"), F.xxhash64("twin", "node")).otherwise(F.col("node"))
        named = lambda df: df.join(alike, "node", "left").withColumn("node", F.coalesce(F.when(F.col("first").isNotNull(), apart), "node")).drop("first")
        classes, sets = staged(named(classes), "classes"), named(sets)
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = staged(banded.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("hub")).where("members > 1"), "buckets")
    member = staged(banded.join(buckets.select("band", "hub"), "band"), "members")
    facts = classes.select("node", "n", "sig")

    @F.pandas_udf("double")
    def similar(a, b):
        if not len(a):
            return a.astype("float64")
        return __import__("pandas").Series(estimate(*(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a, b))))

    # One pair a node: its least hub. What that leaves apart meets in the blocks below.
    pairs = member.where("node <> hub").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a"))
    side = lambda s: facts.select(*[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "sig")])
    pairs = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b")).where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    pairs = staged(pairs.withColumn("e", similar("sig_a", "sig_b")).where(F.col("e") >= floor).select("a", "b"), "pairs")
    want = classes.join(member.select("node").distinct(), "node", "left_semi").select("node", "rep", "rep_hash")
    texts = packed(source, "text").join(want, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))
    texts = staged(texts.select("node", "text"), "texts")
    edges = confirm(pairs, texts, threshold, "edges")
    comps = staged(components(edges), "comps")
    placed = member.select("band", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_comp = placed.groupBy("band", "comp").agg(F.count("*").alias("many"))
    split = by_comp.groupBy("band").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("many", "comp")).alias("major")).where("comps > 1").select("band", "major")
    open_ = placed.join(split, "band").withColumn("minor", F.col("comp") != F.col("major")).drop("major")
    open_ = staged(open_.join(classes.select("node", "n", "sig", "bands"), "node"), "open")
    near = blocked(open_, block, block_bytes).groupBy("band", "lo", "hi").applyInArrow(_similar(floor, threshold), "band long, node long").distinct()
    near = staged(open_.join(near, ["band", "node"], "left_semi"), "near")
    links = blocked(near.join(texts.dropDuplicates(["node"]), "node"), block, block_bytes).groupBy("band", "lo", "hi")
    links = staged(links.applyInArrow(_across(floor, threshold), "a long, b long").distinct(), "links")
    comps = joined(comps, links)
    discard(texts, member, buckets, pairs, open_, near)
    home = classes.join(comps, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = home.groupBy("comp").agg(F.min("rep").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "node", "text_hash").join(home.join(least, "comp").select("node", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), *([F.col("text_hash").alias(text_hash)] if text_hash else []))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash(spark, sf_dir):
    return near_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
