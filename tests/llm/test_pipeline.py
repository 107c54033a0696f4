"""The pipeline's stages against plain Python, and the registered queries."""

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(9)
    more = []
    for i in range(100, 200):
        words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "sun"], 3)) for _ in range(30)]
        if i % 4 == 0:
            words[5] = "zork"
        more.append((i, " ".join(words), "xx", "src", 1))
    spark.createDataFrame([*rows, *more], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    import corpus_pipeline
    from impactgraph.llm import common, minhash, substring

    docs = common.documents(spark, sf_dir)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.staged(stage(spark, docs, sf_dir), name)
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = (before, docs.collect())
    before, after = kept["toxicity"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {i for i in range(100, 200) if i % 4 == 0}
    before, after = kept["exact_dedup"]
    low = lambda r: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
    assert sorted(map(low, after)) == sorted({low(r) for r in before})
    before, after = kept["near_dedup"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) < len(before)
    before, after = kept["substring_dedup"]
    assert len(before) == len(after)
    seen = set()
    for r in sorted(after, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        words = (r["text"] or "").split()
        own = {tuple(words[i : i + 20]) for i in range(len(words) - 19)} if "again" not in words else set()
        assert not own & seen or any("again" in w for w in own & seen)
        seen |= own
    _, packed = kept["best_fit_packing"]
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in after}


def test_registered():
    import __spark_entry__ as entry

    queries = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries} and "pipeline" in queries
    assert set(entry.oracle_sql()) <= set(queries)
