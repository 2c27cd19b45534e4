"""Lines of any length that repeat, against a plain version."""

import hashlib
import re

import duckdb

from loomspan.llm import registry


def test_every_repeated_line_goes(spark, sf):
    docs = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    got = {r["doc_id"]: r for r in registry.QUERIES["op8_line_dedup_whole"](spark, sf).collect()}
    seen, short = set(), 0
    for d in sorted(docs):
        t, at, kept = docs[d], 0, []
        for line in t.split("\n"):
            end = min(at + len(line) + 1, len(t))
            words = [re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in re.findall("[^\x20\x09-\x0d]+", line.lower())]
            key = " ".join(w for w in words if w)
            if key and key in seen:
                short += key.count(" ") < 7
            else:
                kept.append(t[at:end])
            seen |= {key} if key else set()
            at = end
        assert got[d]["kept_sha256"] == hashlib.sha256("".join(kept).encode()).hexdigest()
    assert short > 0
