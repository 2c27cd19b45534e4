"""Each corpus query against a plain version of its contract, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from loomspan.llm import registry

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def run(spark, sf):
    done = {}

    def of(name):
        if name not in done:
            done[name] = [r.asDict(recursive=True) for r in registry.QUERIES[name](spark, sf).collect()]
        return done[name]

    return of


def digest(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_toxicity_held_out(run, sf):
    got = {r["doc_id"]: r for r in run("op1_toxicity")}
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    pairs = [(labels[d], r["predicted"]) for d, r in got.items() if r["held_out"] and d in labels]
    assert sum(a == b for a, b in pairs) / len(pairs) >= 0.8


def test_secrets(run, docs):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in run("op2_secret_ownership"):
        t = docs[r["doc_id"]]
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        base = [f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(spans)]
        assert r["base_sha256"] == digest(",".join(base)) and set(base) <= set(filter(None, r["spans"].split(",")))


def test_near_duplicates(run, docs):
    sets = {}
    for d, t in docs.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and min(len(sets[a]), len(sets[b])) * 5 >= 4 * max(len(sets[a]), len(sets[b])):
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    for r in run("op3_hyperminhash_near_dedup"):
        d = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), top(d), top(d) == d)


def test_extraction(run, sf):
    pages = {p: h for p, h in duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall()}
    for r in run("op4_template_extraction"):
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        import html

        want = " ".join(" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", re.sub(r"</?b>", "", inside)) if b.split())
        assert " ".join(r["text"].split()) == want and r["n_chars"] == len(r["text"])


def test_quality_base(run, docs):
    for r in run("op5_likelihood_quality"):
        t = docs[r["doc_id"]]
        w = WORD.findall(t)
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [s for s in t.split("\n") if WORD.search(s)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_verdict(run, sf):
    good = {d for (d,) in duckdb.sql(f"select doc_id from '{sf}/labels.parquet' where quality = 1").fetchall()}
    rows = [r for r in run("op5_likelihood_quality") if r["doc_id"] in good and not r["base_failed"]]
    assert sum(r["kept"] for r in rows) >= 0.98 * len(rows)


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_personal_data(run, docs):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    for r in run("op6_personal_data"):
        spans = {k: [m.span() for m in re.finditer(p, docs[r["doc_id"]]) if ok(m[0])] for k, (p, ok) in kinds.items()}
        assert all(r[f"n_{k}"] == len(v) for k, v in spans.items())
        assert r["base_sha256"] == digest(",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v))


def test_personal_data_in_other_formats(spark):
    """Planted spans of no base format are found, other numbers are not; the surroundings are those of the tables."""
    from loomspan.llm.pii import find_personal_data

    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    right = "jane.doe (at) mail (dot) org|bob[at]host[dot]net|ann at example dot com|x.y (at) mail.example.com|(030) 123-4567|212-555-7788|(617) 555-0199|call 030 555 4567|0049 30 555-1234".split("|")
    wrong = "2024-01-31|31.12.2023|1234567|1990-2004|978-3-16-148410-0|123 456 789|meet (at) noon|foo@bar|9807915762804490|3.14159265".split("|")
    rows = [(10**9 + i, f"some words stand here, {x} follows them in this text") for i, x in enumerate(right * 5 + wrong * 5)]
    got = {r["doc_id"]: r for r in find_personal_data(frame.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    base = [d for d, t in rows if got[d]["base"]]
    found = [bool(got[d]["added"]) for d, _ in rows if d not in base]
    n = len(right) * 5
    assert not [d for d in base if d < 10**9 + n] and sum(found[:n]) >= 0.8 * n and sum(found[n:]) == 0
    for d, t in rows[:n]:
        for s in got[d]["added"]:
            assert t[s["start"] : s["end"]].strip("( ") in t and s["kind"] in ("contact", "number")
    assert sum(bool(r["added"]) for d, r in got.items() if d < 10**9) <= 0.01 * len(got)


def test_packing(run, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run("op7_cost_balanced_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for d, rows in pieces.items():
        ids, at = np.array([*tokenizer.encode(docs[d], add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= sum(n for parts in sequences.values() for _, n in parts) / 4096 + 2


def unit_spans(text):
    """Places and keys of the units that have a word: lines, cut after a sentence's mark and the blank behind it."""
    at = 0
    for unit in re.split(r"(?<=\n)|(?<=[.!?…][\x20\x09])(?=\S)|(?<=[。！？])", text):
        words = [re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in WORD.findall(unit.lower())]
        words = [w for w in words if w]
        if words:
            yield at, at + len(unit), " ".join(words), len(words)
        at += len(unit)


def test_lines(run, docs):
    seen, got, removed = set(), {r["doc_id"]: r for r in run("op8_line_dedup")}, 0
    for d in sorted(docs):
        t = docs[d]
        gone, chain = set(), []

        def close(chain):
            if sum(n for _, _, n in chain) >= 25:
                gone.update(p for a, b, _ in chain for p in range(a, b))

        for a, b, key, n in unit_spans(t):
            if key in seen:
                chain.append((a, b, n))
            else:
                close(chain)
                chain = []
            seen.add(key)
        close(chain)
        removed += len(gone)
        assert got[d]["kept_sha256"] == digest("".join(c for p, c in enumerate(t) if p not in gone)), d
    assert removed > 0


def test_decontamination(run, docs, sf):
    items = dict(duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in run("op9_template_decontamination")}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert whole <= got and len(got) <= 1.1 * len(whole) + 2


def test_substrings(run, docs):
    seen, got = set(), {r["doc_id"]: r for r in run("op10_suffix_array_dedup")}
    for d in sorted(docs):
        raw = docs[d].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), sum(gone), spans, digest(kept))


def test_pipeline(spark, sf, run, docs, tmp_path):
    frame, ids = spark.read.parquet(f"{sf}/documents.parquet"), set(docs)
    columns = frame.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, frame, sf).write.parquet(path)
        frame = spark.read.parquet(path)
        now = {r["doc_id"] for r in frame.select("doc_id").collect()}
        assert now <= ids
        if name == "quality rules":
            assert now == {r["doc_id"] for r in run("op5_likelihood_quality") if r["kept"]}
        if name == "redaction":
            assert not [r for r in frame.collect() if re.search(r"[\w.]+@mail\d", r["text"])]
        if name in ("redaction", "packing"):
            assert now == ids
        if name != "packing":
            assert frame.columns == columns
        ids = now
