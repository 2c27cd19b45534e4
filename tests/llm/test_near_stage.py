"""The pipeline's near-duplicate stage against brute force on runs of five words."""

import corpus_pipeline

BASE = [f"w{k}" for k in range(60)]


def runs(text, n):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))}


def alike(a, b, n):
    x, y = runs(a, n), runs(b, n)
    return 100 * len(x & y) >= 80 * len(x | y)


def test_stage_takes_five_words(spark):
    texts = [" ".join("edited" if k in places else w for k, w in enumerate(BASE)) for places in ([], [30], [20, 40], [10, 30, 50])]
    texts += [" ".join(BASE), "some other words that stand here alone", "three words only", "three words only"]
    assert alike(texts[0], texts[2], 2) and not alike(texts[0], texts[2], 5)
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j], 5):
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert got == {d for d, u in enumerate(up) if d == u}


def test_stage_on_odd_rows(spark):
    """Of equal rows one stays, also under one id or none; texts without words, and other columns, are left alone."""
    text = " ".join(BASE)
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (None, "a text of its own, told once and nowhere else", "c"), (2, None, "d"), (2, "", "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = corpus_pipeline.near_dedup(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(r["row"] for r in got.collect()) == ["a", "c", "d", "e"]
    assert corpus_pipeline.near_dedup(spark, frame.where("false"), "").collect() == []
