"""Operators on a small fixture with odd rows, held against brute force; empty tables; clashing names."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_units import ENCODER, brute_windows, lower, thue_morse

from impactgraph.llm import ann, dedup, minhash, packing, quality, segmentation, sharding, substring, toxicity, wavelet


def utf8(t):
    return (t or "").encode()


def encoded(t, end):
    return np.array([*ENCODER.tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")


def spark_hash(*values):
    """Spark's xxhash64 of ints and longs, by the public xxhash library."""
    import struct

    import xxhash

    seed = 42
    for kind, v in values:
        seed = seed if v is None else xxhash.xxh64(struct.pack(kind, v), seed=seed).intdigest()
    return seed


def jump_hash(key, buckets):
    """The published jump consistent hash, one key at a time."""
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs, rows, empty):
    own = docs.withColumns({"slot": F.lit("clash"), "pos": F.lit("mine"), "order_hash": F.lit(3), "__order": F.lit(4)})
    out = sharding.shard(own, 5, bucket_bytes=4096)
    assert {"pos", "order_hash", "__order"} <= set(out.columns)
    out = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in rows)
    shards = defaultdict(list)
    for r in out:
        assert r["size"] == len(utf8(r["text"])) + 16 and r["text_crc32"] == zlib.crc32(utf8(r["text"])) and r["law"] == "key"
        key = spark_hash(("<i", 17), ("<q", r["doc_id"]))
        assert (r["shard"], r["grown_shard"]) == (jump_hash(key, 5), jump_hash(key, 6)) and r["grown_shard"] in (r["shard"], 5)
        assert (r["pos"], r["order_hash"], r["__order"]) == ("mine", 3, 4)
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sharding.shard(empty, 5).count() == 0


def test_a_bucket_of_equal_rows_is_shuffled_in_runs(spark):
    df = spark.createDataFrame([(7, "x" * 500)] * 400, "doc_id long, text string")
    out = sharding.shard(df, 3, bucket_bytes=4096).collect()
    assert sorted(r["slot"] for r in out) == list(range(400)) and len({(r["shard"], r["bucket"]) for r in out}) == 1


def test_shuffling_leaves_no_order(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    out = sharding.shard(df, 1, bucket_bytes=1 << 20).collect()
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["slot"])]
    assert abs(np.corrcoef(order, np.arange(2000))[0, 1]) < 0.1


def test_wavelet(docs, rows, empty):
    files = wavelet.write_wavelets(docs.withColumns({"h": F.lit(1), "id": F.lit(2), "planes": F.lit(3)}), shard_tokens=900, part_bytes=8192)
    assert files.count() > 5
    out = wavelet.read_documents(files).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter((r[0], len(e := encoded(r[1], 2)), zlib.crc32(e.tobytes())) for r in rows)
    ordered = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0, *(r["n_tokens"] for r in ordered[:-1])]))
    assert [r["doc_id"] for r in ordered] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert wavelet.read_documents(wavelet.write_wavelets(empty)).count() == 0


def test_wavelet_lookups_over_the_written_table(docs, rows, spark):
    files = wavelet.write_wavelets(docs, shard_tokens=900, part_bytes=8192)
    ordered = sorted(wavelet.read_documents(files).collect(), key=lambda r: r["start"])
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[d, zlib.crc32(encoded(t, 2).tobytes())].append(encoded(t, 2))
    flat = np.concatenate([texts[r["doc_id"], r["ids_crc32"]][0] for r in ordered])
    places = [0, 1, 899, 900, 5000, len(flat) - 1, len(flat), -1]
    assert {r["place"]: r["id"] for r in wavelet.access(files, places).collect()} == {p: flat[p] for p in places if 0 <= p < len(flat)}
    values = [2, int(flat[10]), 50256, 40000]
    assert {r["id"]: r["n"] for r in wavelet.count(files, values).collect()} == {v: int((flat == v).sum()) for v in values}
    at = np.flatnonzero(flat == 2)
    for k in (0, 3, len(at) - 1):
        assert wavelet.locate(files, 2, k) == at[k]
    assert wavelet.locate(files, 2, len(at)) is None and wavelet.locate(files, 2, -1) is None


@pytest.mark.parametrize("key", [dedup.default_key, lambda t: F.pmod(F.xxhash64(t), F.lit(3))], ids=["plain", "colliding"])
def test_exact_dedup(docs, rows, empty, key):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1] or "")].append(r[0])
    out = dedup.exact_dedup(docs.withColumns({"kept": F.lit(1), "key": F.lit("k"), "__key": F.lit(5), "bucket": F.lit(6), "norm": F.lit(7)}), capacity=2, key=key).collect()
    assert len(out) == len(rows)
    for r in out:
        t = lower(r["text"] or "")
        ids = [i for i in groups[t] if i is not None]
        keep = max(ids) if ids else None
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(groups[t]), r["doc_id"] == keep, hashlib.sha256(t.encode()).hexdigest())
        assert (r["key"], r["__key"], r["bucket"], r["norm"]) == ("k", 5, 6, 7)
    assert dedup.exact_dedup(empty, key=key).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    directory = dedup.build_directory(keys, 10)
    found = dedup.addressed(keys, directory)
    assert found.count() == 3000 and all(r["count"] <= 10 for r in found.groupBy("bucket").count().collect())
    all_keys = [r[0] % 2**64 for r in keys.collect()]
    for r in directory.groupBy("bucket", "depth").count().collect():
        prefix = r["bucket"] >> (dedup.MAX_DEPTH - r["depth"])
        assert prefix << (dedup.MAX_DEPTH - r["depth"]) == r["bucket"]
        parent = sum(k >> (64 - r["depth"] + 1) == prefix >> 1 for k in all_keys)
        assert r["depth"] == 0 or parent > 10  # a bucket is split only when it is overfull
    same = spark.range(30).select(F.lit(5).cast("long").alias("key"))
    assert dedup.addressed(same, dedup.build_directory(same, 10)).count() == 30


def test_lookups_go_through_the_directory(docs, rows):
    directory, index = dedup.build_index(docs, capacity=2)
    assert dedup.lookup(docs, directory, index).count() == len(rows)
    moved = directory.where("bucket = 0").limit(1).select("slot").first()
    first = directory.orderBy("slot").first()["slot"] if moved is None else moved["slot"]
    broken = directory.withColumn("bucket", F.when(F.col("slot") == first, F.lit(1 << 20)).otherwise(F.col("bucket")))
    lost = len(rows) - dedup.lookup(docs, broken, index).count()
    assert 0 < lost < len(rows)


def test_hot_groups_and_chains(spark):
    """A third of all rows are one text; its key collides or not."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "HOT text").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("long").cast("string"))).alias("text"))
    for key in (dedup.default_key, lambda t: F.pmod(F.xxhash64(t), F.lit(40))):
        out = dedup.exact_dedup(df, capacity=100, key=key)
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in out.collect()}
        assert len(got) == 3000 and got[0] == got[2997] == (2997, 1000)
        assert got[1] == (1, 1) and got[4] == got[5] == (5, 2)


@pytest.mark.parametrize("base", [10, 5])
def test_substring_dedup(docs, rows, empty, base):
    unique = {(r[0], r[1]) for r in rows}
    order = sorted(unique, key=lambda r: (r[0] is None, r[0] or 0))
    gone = brute_windows([utf8(t).split() for _, t in order], 20)
    want = {}
    for (d, t), g in zip(order, gone, strict=True):
        words = utf8(t).split()
        want[d, t] = (len(words), sum(g), b" ".join(w for w, x in zip(words, g, strict=True) if not x).decode())
    out = substring.substring_dedup(docs.withColumns({c: F.lit(9) for c in ("marks", "__marks", "id", "h", "__null", "__packed")} | {"n_words": F.lit("clash")}), base=base).collect()
    assert len(out) == len(rows) and any(v[1] for v in want.values())
    for r in out:
        assert all(r[c] == 9 for c in ("marks", "__marks", "id", "h", "__null", "__packed")) and r["source"] == next(x[3] for x in rows if x[0] == r["doc_id"])
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"], r["text"]]
    assert substring.substring_dedup(empty, base=base).count() == 0
    with pytest.raises(ValueError):
        substring.substring_dedup(empty, base=6)


def test_substring_tasks_remember_hot_windows(spark, monkeypatch):
    """A passage in most documents, in batches of a few rows, with tables that overflow."""
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefgh"), 6))
    passages = [[word() for _ in range(30)] for _ in range(3)]
    docs = []
    for i in range(90):
        own = [word() for _ in range(12)]
        docs.append((i, own + passages[i % 3] + [word() for _ in range(5)] if i % 4 else own))
    want = {i: (len(w), sum(g)) for (i, w), g in zip(docs, brute_windows([w for _, w in docs], 20), strict=True)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in reversed(docs)], "doc_id long, text string").coalesce(1)
    from impactgraph.llm import common

    monkeypatch.setattr(substring, "small_batches", lambda spark: (common.ship(spark), spark.conf.set(common.ARROW_ROWS, "7")))
    for hot in (1 << 17, 16):
        monkeypatch.setattr(substring, "HOT", hot)
        assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.substring_dedup(df).collect()} == want
    common.small_batches(spark)


def test_texts_that_a_polynomial_hash_confuses_stay_apart(spark):
    a, b = thue_morse(1024)
    df = spark.createDataFrame([(1, f"word one two three {a}"), (2, f"word one two three {b}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(df).collect()} == {1: 1, 2: 2}
    rest = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert {r["n_removed"] for r in substring.substring_dedup(df).collect()} == {0}


def test_near_dedup(docs, rows, empty):
    sets = []
    for r in rows:
        words = lower(r[1] or "").encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(s), least.get(find(i)), r[0] == least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_dedup(docs.withColumns({c: F.lit("clash") for c in ("node", "n_shingles", "text_hash", "kept")}), block=3).collect())
    assert got == want and max(Counter(find(i) for i in range(len(rows))).values()) > 1
    assert minhash.near_dedup(empty).count() == 0


def test_near_dedup_chains(spark):
    """Documents linked only through others, in one bucket family, end in one component."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[8 * k : 8 * k + 120]) for k in range(25)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for args in ({"block": 4}, {"block_bytes": 600}):
        assert {r["component_id"] for r in minhash.near_dedup(df, **args).collect()} == {0}


def test_classes_of_one_name_are_told_apart(spark, monkeypatch):
    """All sets get one 64-bit name; the other half of the digest still separates them."""
    texts = ["a b c d e f", "a b c d e f", "g h i j k l", "m n o p q r s"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    true = minhash.node_of
    monkeypatch.setattr(minhash, "node_of", lambda s: (5, true(s)[1]))
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_families_near_the_threshold(spark):
    """Templates whose texts differ by a few words, below and above the threshold, in many buckets: all pairs against brute force."""
    r = np.random.default_rng(12)
    docs = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(25):
            words = list(base)
            for i in r.choice(60, int(r.integers(0, 6)), replace=False):
                words[int(i)] = f"x{r.integers(10**9)}"
            docs.append(words)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs]
    comp = list(range(len(docs)))
    for _ in docs:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if comp[j] < comp[i] and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_dedup(df, block=6).collect()}
    assert [got[i] for i in range(len(docs))] == comp and len(set(comp)) > 8


def test_packing(docs, rows, empty):
    out = packing.pack(docs.withColumns({c: F.lit("clash") for c in ("length", "salt", "ids", "at")}), capacity=256, rank_rows=3)
    got = out.collect()
    want = Counter()
    for r in rows:
        ids, at, piece = encoded(r[1], 0), 0, 0
        while at < len(ids):
            size = (len(ids) - 1) % 256 + 1 if not piece else 256
            want[r[0], piece, at, size, zlib.crc32(ids[at : at + size].tobytes())] += 1
            at, piece = at + size, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert sum(n for _, n in s) <= 256 and [o for o, _ in s] == list(np.cumsum([0, *(n for _, n in s[:-1])]))
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 256) + 2
    assert sum(len(r["ids"]) for r in packing.sequences(out).collect()) == total
    assert packing.pack(empty).count() == 0


def test_segment(docs, rows, empty):
    out = segmentation.segment(docs.withColumns({"score": F.lit("clash"), "nbest": F.lit("mine")}), with_ids=False).collect()
    assert all(r["nbest"] == "mine" for r in out)
    out = segmentation.segment(docs.withColumn("score", F.lit("clash"))).collect()
    assert len(out) == len(rows) and all(r["round_trip"] for r in out)
    for r in out:
        assert r["n_pieces"] == len(r["nbest"][0]["ids"]) // 4 and (r["n_pieces"] == 0) == (not r["text"])
        scores = [x["score"] for x in r["nbest"]]
        assert scores == sorted(scores, reverse=True) and len({bytes(x["ids"]) for x in r["nbest"]}) == r["n_found"]
    assert segmentation.segment(empty).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic documents hold an insult; poor ones repeat one word."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "sun"], 3)) for _ in range(40)]
        toxic, poor = i % 5 == 0, i % 4 == 0
        if toxic:
            words[int(rng.integers(40))] = ["Zork", "blargs", "zorking"][i % 3]
        if poor:
            words = [words[0] + "!"] * 40 + [w for w in words if w.lower().startswith(("zork", "blarg"))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(500, None), (501, ""), (502, "zork " * 30000), (None, "some zork text"), (503, "kaka lolo")]
    labels += [(500, None, None), (None, 1, 1), (999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(labelled, empty):
    docs, labels = labelled
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs.withColumn("evidence", F.lit(1)), labels).collect()}
    assert len(out) == docs.count()
    assert all(out[i]["predicted"] == (i % 5 == 0) for i in range(400)) and all(0 <= r["score"] <= 1 for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items() if d is not None)
    assert out[502]["predicted"] == 1 and out[500]["predicted"] == 0 and out[501]["evidence"] == [] and out[0]["evidence"][0]["label"] == 1
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_quality(labelled, empty):
    docs, labels = labelled
    out = {r["doc_id"]: r for r in quality.quality(docs.withColumn("score", F.lit("clash")), labels).collect()}
    assert np.mean([out[i]["predicted"] == (i % 4 != 0) for i in range(400)]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[500]["score"] == out[501]["score"]
    assert quality.quality(empty, labels).count() == 0
    assert len({r["score"] for r in quality.quality(docs, labels.limit(0)).collect()}) == 1


def test_long_labelled_texts_are_learnt_from(spark):
    """Only the longest texts show what is toxic or poor; nothing of them goes to the driver but counts."""
    words = lambda i, n: " ".join(f"w{(i * 7919 + k) % 997}" for k in range(n)).replace("1", "a").replace("2", "b")
    rows = [(i, words(i, 20_000) + (" zork" if i % 2 else "")) for i in range(24)] + [(100, "zork"), (101, "waa")]
    labels = [(i, i % 2, i % 2) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert min(len(t) for _, t in rows[:24]) > 60_000
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {e["doc_id"] for e in out[100]["evidence"]} == {i for i in range(24) if i % 2 and zlib.crc32(str(i).encode()) % 3 != 1}


def test_compiled_rules_equal_the_ensemble(labelled):
    docs, _ = labelled
    names = quality.NAMES
    rows = docs.select("doc_id", *[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).collect()
    x = np.array([list(r)[1:] for r in rows], dtype=float)
    y = (x[:, names.index("distinct_words")] > np.median(x[:, names.index("distinct_words")])).astype(float)
    intercept, rules = quality.fit(x, y, np.ones(len(y)))
    assert rules
    want = 1 / (1 + np.exp(-(intercept + sum(w * quality.applies(r, x) for r, w in rules))))
    stats = quality.statistics(F.col("text"))
    got = [r[0] for r in docs.select(quality.compile_rules(intercept, rules, [stats[n] for n in names])).collect()]
    assert np.allclose(got, want)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[40:60] = x[0]  # copies: ties go to smaller ids
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [1.0, None] * 4), (1400, [1.0] * 3), (None, [1.0] * 8), rows[100]]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    out = ann.search(df, df.where("vec_id % 50 = 0 AND vec_id < 1000")).collect()
    assert all(0.9 <= r["recall"] <= 1 for r in out)
    hit = 0
    for q in (0, 50, 100, 150, 200, 250):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(300), d))[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and np.allclose([s for _, _, s in own], d[[v for _, v, _ in own]])
        hit += len(set(want) & {v for _, v, _ in own})
        if q in (0, 50):
            assert [v for _, v, _ in own] == list(want)
    assert {r["query_id"] for r in out} == {0, 50, 100, 150, 200, 250} and hit >= 54
    assert ann.search(df.limit(0), df).count() == 0
    exact = ann.search(df, df.where("vec_id % 50 = 0 AND vec_id < 1000"), target=2.0, block=50).collect()  # no probes reach it: all entries are met
    for q in (0, 50, 100, 150, 200, 250):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [v for _, v in sorted((r["rank"], r["vec_id"]) for r in exact if r["query_id"] == q)] == list(np.lexsort((np.arange(300), d))[:10])
    assert {r["recall"] for r in exact} == {1.0}


def test_lonely_queries_meet_everything(spark):
    """A query far from all others finds no bucket mates, and still gets its ten nearest; other lengths are searched on their own."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 6))
    x[0] += 500
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [float(i + 1)] * 3) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.search(df, df.where("vec_id IN (0, 1001)"), block=100).collect()
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    d[0] = np.inf
    assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == 0), key=lambda r: r["rank"])] == list(np.argsort(d)[:10])
    assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == 1001), key=lambda r: r["rank"])] == [1000, 1002, 1003]
