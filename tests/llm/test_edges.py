"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import extraction, gbt, graph, neardup, packing, paragraphs, pii, secrets, substrings, toxicity
from loomspan.llm.decontaminate import decontaminate, matches
from loomspan.llm.quality import quality
from loomspan.llm.suffix import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, spans string, words string, key string"
LONG = "word " * 40_000 + "x" * 50_000 + " a@b.example 4111 1111 1111 1111 " * 300
ROWS = [
    (1, "The same text, told here twice over, is long enough to be a line of its own for sure.", "en", "s", 1, 1, "x", "x", "x"),
    (2, "The same text, told here twice over, is long enough to be a line of its own for sure.", "en", "s", 1, 1, "x", "x", "x"),
    (2, "The same text, told here twice over, is long enough to be a line of its own for sure.", "en", "s", 1, 1, "x", "x", "x"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "s", 0, 1, "x", "x", "x"),
    (5, " \n\t ", "en", "s", 0, 1, "x", "x", "x"),
    (None, "a null id with password=hunter22 in it", "en", None, 1, 1, "x", "x", "x"),
    (7, LONG, "en", "s", 1, 1, "x", "x", "x"),
    (8, "one", "en", "s", 1, 1, "x", "x", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


def items(spark, rows=((1, "told here twice over, is long enough to be"), (2, None), (None, "a b"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_one_row_each(spark, odd, empty, labels):
    makers = {
        "toxicity": lambda d: toxicity.score(d, labels),
        "secrets": secrets.find_secrets,
        "near": neardup.near_duplicates,
        "quality": lambda d: quality(d, labels),
        "personal": pii.find_personal_data,
        "lines": paragraphs.remove_repeated_lines,
        "substrings": substrings.remove_repeats,
    }
    for name, make in makers.items():
        got = make(odd).collect()
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
        assert ids == sorted((r[0] is None, r[0] or 0) for r in ROWS), name
        assert make(empty).collect() == [], name


def test_near_duplicates(odd):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(odd).collect()}
    assert got[2]["component_id"] == 1 and not got[2]["kept"]
    assert got[4]["n_shingles"] == 0 and got[4]["kept"] and got[5]["component_id"] == 5
    assert got[8]["n_shingles"] == 1 and got[None]["kept"] and got[None]["component_id"] is None


def test_large_family_of_near_copies(spark):
    """Copies that differ from one original by a few words each, many of them not linked to one another."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words)]
    for _ in range(700):
        own = list(words)
        for p in rng.choice(120, rng.integers(2, 14), replace=False):
            own[p] = f"n{rng.integers(10**9)}"
        texts.append(" ".join(own))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    codes = {x: i for i, x in enumerate({x for s in sets for x in s})}
    m = np.zeros((len(sets), len(codes)), np.float32)
    for i, s in enumerate(sets):
        m[i, [codes[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(1)
    linked = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    least = np.arange(len(sets))
    while True:
        new = np.array([least[row].min() for row in linked])
        if (new == least).all():
            break
        least = new
    assert [got[i] for i in range(len(sets))] == least.tolist()


def test_long_texts_of_matches(spark):
    df = spark.createDataFrame([(1, "a@b.cd " * 3000 + "9" * 30_000 + " +1 234 567 890 12"), (2, "a@b.cd_x@d.ef 1.2.3.4.5.6.7.8 300.1.1.1")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    assert sum(s["kind"] == "email" for s in got[1]["base"]) == 3000
    assert [(s["kind"], s["start"], s["end"]) for s in got[2]["base"]] == [("email", 0, 6), ("email", 6, 13), ("ip", 14, 21), ("ip", 22, 29)]


def test_redaction_keeps_columns(odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS)
    text = next(r["text"] for r in out.collect() if r["doc_id"] == 7)
    assert "a@b.example" not in text and "<email>" in text and "<card>" in text


def test_owners_tell_examples_from_secrets(spark):
    key = "Zx9Qw8Er7Ty6Ui5Op4As3Df2Gh1Jk0"
    rows = [(i, f"use {key} here", f"o{i}") for i in range(4)] + [(9, "mine is Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8Ii9 only", "o9")]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == [] and [s["verdict"] for s in got[9]] == ["live"]


def test_secret_matches_are_not_retried(spark):
    rows = [(1, "password=token:abcdefgh secret='abcdef' api-key=zzzzzz APIKEY: abcdefg")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' source")).first()["spans"]
    assert [(s["start"], s["end"]) for s in got] == [(24, 38), (55, 70)]


def test_decontamination(spark, odd, empty):
    bank = items(spark)
    assert {r["doc_id"] for r in matches(odd, bank).collect()} == {1, 2}
    assert decontaminate(odd, bank).columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in decontaminate(odd, bank).collect()) == [0, 3, 4, 5, 7, 8]
    assert decontaminate(empty, bank).collect() == [] and decontaminate(odd, items(spark, [(1, None)])).count() == len(ROWS)


def test_items_of_few_words_are_not_looked_for(spark):
    docs = spark.createDataFrame([(1, "what is the answer, one may ask"), (1, "what is the answer, one may ask")], "doc_id long, text string")
    assert matches(docs, items(spark, [(1, "what is the answer")])).collect() == []
    twice = matches(docs, items(spark, [(1, "what is the answer, one may ask"), (1, "what is the answer, one may ask"), (2, "one may ask")])).collect()
    assert [(r["doc_id"], r["item_id"], r["verdict"]) for r in twice] == [(1, 1, "verbatim")] * 2


def test_reparameterised_item(spark):
    bank = items(spark, [(1, "a train leaves the town of Springfield at 60 km per hour and travels for 3 hours")])
    docs = [(1, "a train leaves the town of Rivertown at 75 miles per hour and travels for 9 hours"), (2, "a train leaves the town of Springfield at 60 km per hour and travels for 3 hours")]
    assert {r["doc_id"]: r["verdict"] for r in matches(spark.createDataFrame(docs, "doc_id long, text string"), bank).collect()} == {1: "reparameterised", 2: "verbatim"}


def test_packing(odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(odd, path, sequence=64, group_sequences=4).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in ROWS} and all(len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 64 for r in got)
    assert packing.pack_documents(empty, path).collect() == []


@given(st.lists(st.integers(1, 300), max_size=60))
@settings(max_examples=200, deadline=None)
def test_balance(lengths):
    pieces = packing.balance(lengths, 64)
    used = {}
    for d, start, n, s, offset in pieces:
        assert 0 < n <= 64
        used.setdefault(s, []).append((offset, n))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(used) == -(-sum(lengths) // 64)
    for d, k in enumerate(lengths):
        assert sum(p[2] for p in pieces if p[0] == d) == k


@given(st.lists(st.integers(0, 3), max_size=80))
@settings(max_examples=300, deadline=None)
def test_suffix_array(s):
    assert suffix_array(np.array(s, np.uint8)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("block_contexts", [2, 4096])
def test_substrings_in_blocks_and_by_windows(spark, block_contexts):
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh ñ"), 160))
    texts = ["".join(rng.choice(list("xyz"), 30)) + passage[rng.integers(0, 40) :][: rng.integers(90, 160)] + "".join(rng.choice(list("xyz"), 30)) for _ in range(40)] + ["a" * 500, "", "a" * 99]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in substrings.remove_repeats(df, block_contexts=block_contexts).collect()}
    seen = set()
    for d, t in enumerate(texts):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        assert got[d] == bytes(b for b, g in zip(raw, gone, strict=True) if not g)


def test_lines_keep_offsets(spark):
    line = "one two three four five six seven eight"
    df = spark.createDataFrame([(2, f"first\n{line.upper()}.\nlast"), (1, line)], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept_text"], [tuple(s) for s in r["spans"]]) for r in paragraphs.remove_repeated_lines(df, min_words=8).collect()}
    assert got == {1: (line, []), 2: ("first\nlast", [(6, 47)])}
    assert all(r["spans"] == [] for r in paragraphs.remove_repeated_lines(df).collect())


def test_passages_from_the_middle_of_lines(spark):
    """A passage of short sentences goes from where it was copied to; its sentences stay where they stand alone."""
    passage = " ".join(f"Sentence number {k} is short." for k in range(12))
    rows = [(1, f"A first text. {passage} It ends here."), (2, f"Another one begins. {passage}\n\nAnd goes on."), (3, "Sentence number 4 is short. Nothing else of it."), (None, passage)]
    got = {r["doc_id"]: (r["kept_text"], [tuple(s) for s in r["spans"]]) for r in paragraphs.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = len("Another one begins. ")
    assert got == {1: (rows[0][1], []), 2: ("Another one begins. \nAnd goes on.", [(at, at + len(passage) + 1)]), 3: (rows[2][1], []), None: ("", [(0, len(passage))])}


def test_pages(spark):
    page = "<html><body><nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p>Body <b>of</b>\n {n}<p>end</article><section class='comments'><p>me too</p></section><footer>f</footer>"
    rows = [(1, "http://h/1", page.replace("{n}", "1")), (None, None, None), (3, "x", ""), (4, "http://h/2", "<p>plain</p><script>var a='</p>'</script>"), (4, "http://h/2", "<p>plain</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in extraction.extract(df).collect())
    assert got == [(0, ""), (1, "T & U Body of 1 end"), (3, ""), (4, "plain"), (4, "plain")]
    assert extraction.extract(df.where("false")).collect() == []


def pages_of(spark, bodies):
    return spark.createDataFrame([(i, f"http://host/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string")


def texts_of(df):
    return [r["text"] for r in sorted(extraction.extract(df).collect(), key=lambda r: r["page_id"])]


WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ilex juniper".split()


def told(i, n=12):
    return " ".join(WORDS[(i * 7 + k * k) % 10] + str(i) for k in range(n))


def test_template_of_a_host_without_roles(spark):
    """Plain divs: only the host's template tells the text from page-specific lines and repeated notices."""
    body = "<div class='q1'><a href=x>Home {k}</a> <a href=y>News</a></div><div class='q2'>By author {i} on day {i}</div><div class='q3'><p>{a}</p><p>Read this notice first.</p><p>{b}</p></div><div class='q4'><p>user{i} says hello</p></div>"
    bodies = [body.format(i=i, k=i % 2, a=told(i), b=told(i + 50)) for i in range(10)]
    df = pages_of(spark, bodies)
    assert texts_of(df) == [f"{told(i)} {told(i + 50)}" for i in range(10)]
    alone = [extraction.main_text(f"<html><body>{b}</body></html>", frozenset(), frozenset(), frozenset(), {}) for b in bodies]
    assert all("notice" in a for a in alone)  # without the template the results differ


def test_contract_of_pages(spark):
    """Wrappers that mention a sidebar, sections named related-work, captions, formulas and titles in an article's header stay."""
    bodies = [
        "<div class='content with-sidebar'><p>Body text of the page</p></div>",
        "<article><header><h1>Title</h1><p>by someone</p></header><p>One two three</p><div class='related-work'><p>Earlier work</p></div><figure><img><figcaption>A caption</figcaption></figure><math><mi>x</mi></math></article><aside>Other</aside>",
        "<nav>Menu</nav><main><p>Plain main text</p><div class='comments'><p>me too</p></div></main><footer>End</footer>",
    ]
    got = [texts_of(pages_of(spark, [b]))[0] for b in bodies]
    assert got == ["Body text of the page", "Title One two three Earlier work A caption x", "Plain main text"]


def test_long_page(spark):
    text = "word " * 60_000
    assert texts_of(pages_of(spark, [f"<article><p>{text}</p></article>"])) == [text.strip()]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_trees_and_calibration(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.7).astype(float)
    trees = gbt.Trees().fit(x, y)
    assert ((trees.margin(x) > 0) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r[0] for r in df.select(trees.column([F.col(c) for c in "abc"])).collect()]
    assert np.allclose(got, trees.margin(x[:50]))
    knots, values = gbt.isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()


def test_capitals_count_alike_in_texts_of_any_length():
    unit = "Ты ПЛОХОЙ Ωμέγα ЖⅠ Abc "
    short, long = (toxicity.features(unit * n, {}) for n in (10, 1000))
    assert short[12] == long[12] == sum(map(str.isupper, unit)) / len(unit)
