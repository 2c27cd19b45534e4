"""Repeated byte strings in rows with null and repeated ids, against a plain version."""

import numpy as np

from loomspan.llm import substrings


def test_rows_of_one_id_are_apart(spark):
    rng = np.random.default_rng(5)
    made = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared, other = made(150), made(130)
    rows = [(None, made(40) + shared + made(300)), (None, made(40) + other), (2, made(60) + shared + made(90)), (1, other + made(20)), (2, "x" * 70), (None, made(40) + other + shared), (3, made(400))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seen, want = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw, gone = t.encode(), bytearray(len(t))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        want.append((d, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    got = [(r["doc_id"], bytes(r["kept"])) for r in substrings.remove_repeats(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
