import random


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline

    r = random.Random(5)
    text = lambda: " ".join(str(r.randrange(10**6)) for _ in range(80))
    first, own, other = text(), text(), text()
    rows = [(3, first), (5, own), (5, first + " more"), (7, other), (None, text()), (None, other + " more"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(x) for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(rows) - {rows[2], rows[5]}
