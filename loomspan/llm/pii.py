"""Personal data in texts: formats, and boosted trees over broader candidates.

Base kinds are found by their formats and always stay. High-recall generators propose further spans, which may overlap:
anything around an at sign or a spelled-out one, and any run of digits with separators. Each proposal is described by its
format (lengths, digits, separators, groups) and by its context (marks, words and digits on either side); boosted trees
with an isotonic threshold decide which proposals become added spans.

The tables hold no labels for such data, and base spans can't serve as labels: what they cover needs no adding. So labels
are made, on a bounded sample. Label 1: base addresses and phone numbers of the corpus, in their own surroundings, with
their base format masked by another one (spelled-out at and dot; numbers without country code, with 00, other separators).
Label 0: number and word formats that are not personal, filled from hashes, at hashed places of the texts, and the
corpus's own proposals beside base spans, less those that a personal word precedes, that spell out an at, or that trees
fitted on the made labels alone take for a variant: all of these may be what is looked for. Half of the sample fits the trees; on the other half the threshold lies half-way between the
least score from which on at least PRECISION of the labels are 1 and the next lower one. Of what scores there and overlaps no base span, the longest of each place is added.

Matching, features, scores and selection are built-in expressions on one row; only the fit sees collected numbers.

Defined results: a null text is empty; null ids stay null; repeated rows are scanned one by one; an empty table gives an
empty result; where the corpus holds too few base addresses and numbers to make labels of, nothing is added; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common
from loomspan.llm.gbt import Trees, isotonic
from loomspan.llm.spans import how_many, let, places, written

# The formats of the base kinds, as the contract states them. Guards make a match start where its run
# starts, or where the last match ended, so that long runs cost linear time; possessive groups don't recurse.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
KINDS = ("email", "ip", "card", "phone")

#: Generators of proposals. The first takes an at sign, plain or spelled, with what stands around it.
AROUND_AT = r"(?:\G|(?<![\w.%+-]))[\w.%+-]+(?:@|\x20?[\[(](?i:at)[\])]\x20?|\x20(?i:at)\x20(?=[\w-]+\x20(?i:dot)\x20))[\w-]+(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?|\x20(?i:dot)\x20)[\w-]+)*+"
DIGITS = r"(?:\G|(?<![\w+(]))[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,40}+"

#: Labelled rows that the trees are fitted on: half variants of base spans, half others.
SAMPLE = 20_000
PRECISION = 0.98
NEAR = 24
# Words before personal data and before other numbers; spelled-out marks; formats that are not personal
# (9 stands for a digit, w for a word of the text).
PERSONAL = r"(?i)(mail|phone|tel|call|fax|mobile|cell|dial|sms|whatsapp|card|visa|account|iban|address|contact|reach)[^\w]{0,3}(?:me|us|at|on|is|by)?[^\w]{0,3}$"
OTHER = r"(?i)(total|page|no|nr|number|version|year|order|invoice|item|isbn|id|ref|code|date|since|€|\$|#)[^\w]{0,3}$"
ATS = (" (at) ", " [at] ", "[at]", "(at)", " at ")
DOTS = (" (dot) ", " [dot] ", "[dot]", ".", " dot ")
PLAIN = ("9999-99-99", "99.99.9999", "9999 99 99", "9999999", "999999999", "9999999999999999", "9999 9999 9999 9999", "9.9.9.99.999", "9999-9999", "999 999 999", "978-9-99-999999-9", "9999999.99", "w (at) w", "w@w", "w [at] w", "w9 (at) w99", "w99@w9", "w9 [at] w")

#: Variants, and others, without which the trees are not fitted.
LEAST = 40
#: Formats that a base span is rewritten in.
FORMATS = 7
FEATURES = 21

SPAN = "array<struct<start: bigint, rank: int, end: bigint, kind: string, value: string>>"


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")).otherwise(
            (F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return total % 10 == 0


def _card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _kept(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return _card(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _context(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    before = F.substring(text, F.greatest(start - NEAR, F.lit(0)).cast("int") + 1, F.least(start, F.lit(NEAR)).cast("int"))
    return before, F.substring(text, end.cast("int") + 1, F.lit(NEAR))


def _features(value: Column, before: Column, after: Column) -> Column:
    count = lambda v, p: F.regexp_count(v, F.lit(p)).cast("double")
    flag = lambda c: c.cast("double")
    return F.array(
        F.length(value).cast("double"),
        count(value, "[0-9]"),
        count(value, "[0-9]+"),
        count(value, "[A-Za-z]"),
        count(value, r"\."),
        count(value, r"[\x20-]"),
        count(value, r"[()]"),
        flag(value.rlike(r"^(\+|00)")),
        flag(value.rlike(r"^\(?0")),
        flag(value.contains("@")),
        flag(value.rlike(r"(?i)[\[(]at[\])]|\x20at\x20")),
        flag(value.rlike(r"(?i)(\.|dot[\])]?\x20?)[a-z]{2,}$")),
        flag(value.rlike("[0-9]{8}")),
        F.length(F.regexp_extract(value, r"([0-9]*)\)?$", 1)).cast("double"),
        F.length(F.regexp_extract(value, r"^[+(]?([0-9]*)", 1)).cast("double"),
        flag(value.rlike(r"^((19|20)[0-9]{2}[-. ][01]?[0-9][-. ][0-3]?[0-9]|[0-3]?[0-9][-. ][01]?[0-9][-. ](19|20)[0-9]{2})$")),
        flag(before.rlike(PERSONAL)),
        flag(before.rlike(OTHER)),
        count(before, "[0-9]"),
        count(after, "[0-9]"),
        flag(after.rlike(r"^[^\w]|^$")),
    )


def _scanned(docs: DataFrame, id_col: str, text_col: str, held: Column | None = None) -> DataFrame:
    """(row, doc_id, base, more, seeds): base spans, proposals with features and whether a base span overlaps them, and
    the base addresses and phone numbers with their contexts. With held, that column and the text stay beside them."""
    keep = [] if held is None else ["text", "held"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), *([] if held is None else [held.alias("held")]))
    patterns = (EMAIL, IP, CARD, PHONE, AROUND_AT, DIGITS)
    text = F.col("text")
    found = rows.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(patterns)))
    empty = F.array().cast(SPAN)

    def base_of(k: int) -> Column:
        spans = places(text, patterns[k], KINDS[k], k, F.col(f"m{k}"))
        return F.when(F.size(f"m{k}") > 0, F.filter(spans, lambda s: _kept(KINDS[k], s["value"]))).otherwise(empty)

    found = found.withColumn("base", F.concat(*(F.array_sort(base_of(k)) for k in range(4))))
    more = F.concat(*(F.when(F.size(f"m{k}") > 0, places(text, patterns[k], n, k, F.col(f"m{k}"))).otherwise(empty) for k, n in ((4, "contact"), (5, "number"))))
    found = found.select("doc_id", "text", "base", more.alias("more"), *keep[1:])

    def marked(s: Column) -> Column:
        before, after = _context(text, s["start"], s["end"])
        known = F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        maybe = before.rlike(PERSONAL) | s["value"].rlike(r"(?i)[\[(]at[\])]|\x20at\x20")
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), known.alias("known"), maybe.alias("maybe"), _features(s["value"], before, after).alias("x"))

    def seed(s: Column) -> Column:
        before, after = _context(text, s["start"], s["end"])
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["value"].alias("value"), before.alias("before"), after.alias("after"))

    short = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind")))
    seeds = F.transform(F.filter("base", lambda b: b["kind"].isin("email", "phone")), seed)
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", short.alias("base"), F.transform("more", marked).alias("more"), seeds.alias("seeds"), *keep)


def _one_of(texts: tuple[str, ...], k: Column) -> Column:
    return F.get(F.array(*(F.lit(t) for t in texts)), F.pmod(k, F.lit(len(texts))).cast("int"))


def _variants(scanned: DataFrame) -> DataFrame:
    """(h, y, x): base addresses and numbers in FORMATS others, in their own contexts."""
    seeds = scanned.where(F.size("seeds") > 0).select("row", F.explode("seeds").alias("s")).select("row", "s", F.explode(F.sequence(F.lit(0), F.lit(FORMATS - 1))).alias("j"))
    seeds = seeds.select(F.xxhash64("row", "s.start", "s.kind", "j").alias("h"), "j", "s.*")
    local = F.regexp_replace("value", r"^\+[0-9]{1,3}[\x20.-]*", "")
    bare = F.regexp_replace(local, "[()]", "")
    abroad = F.concat(F.lit("00"), (F.pmod(F.floor(F.col("h") / 16), F.lit(90)) + 10).cast("string"), F.lit(" "), bare)
    formats = (local, bare, F.regexp_replace(bare, r"[\x20.]+", "-"), F.concat(F.lit("00"), F.substring("value", 2, 1000)), F.regexp_replace(bare, r"[\x20-]+", "."), F.concat(F.lit("0"), bare), abroad)
    number = F.get(F.array(*formats), F.col("j"))
    at = F.length(F.substring_index("value", "@", 1))
    host = F.substring("value", at + 2, F.length("value"))
    place = F.floor(F.pmod("h", F.lit(1 << 40)) / 8)
    plain = lambda c, bit: F.when(F.pmod(F.floor(F.col("h") / 64), F.lit(4)) >= bit, F.regexp_replace(c, r"[0-9]+[._-]?|[._-][0-9]+", "")).otherwise(c)
    user, host = plain(F.substring_index("value", "@", 1), 2), plain(host, 1)
    spelled = F.concat(F.when(F.length(user) > 0, user).otherwise(F.substring_index("value", "@", 1)), _one_of(ATS, F.col("h")), F.array_join(F.split(host, r"\."), "\u0001"))
    address = F.replace(spelled, F.lit("\u0001"), _one_of(DOTS, place))
    made = seeds.withColumn("v", F.when(F.col("kind") == "phone", F.trim(number)).otherwise(address))
    made = made.where((F.col("kind") == "email") | F.col("v").rlike(r"^[(]?[0-9]+[\x20().-]+[0-9]"))
    return made.select("h", F.lit(1).alias("y"), _features(F.col("v"), F.col("before"), F.col("after")).alias("x"))


def _others(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, y, x): formats that are not personal, one for each text, at a hashed place of it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(text)
    at = F.when(F.length(text) > 0, F.pmod(h, F.greatest(F.length(text), F.lit(1)))).otherwise(F.lit(0))
    rows = docs.where(F.length(text) > 0).select(h.alias("h"), F.substring(text, F.greatest(at - NEAR, F.lit(0)).cast("int") + 1, F.lit(2 * NEAR)).alias("near")).orderBy("h", "near").limit(SAMPLE // 2)
    before, after = F.regexp_extract("near", r"(?s)^(.*?)\S*$", 1), F.regexp_extract("near", r"(?s)^.*?(\s.*)$", 1)
    digits = F.conv(F.substring(F.md5(F.col("h").cast("string")), 1, 12), 16, 10)
    word = F.regexp_extract("near", r"(\w+)", 1)
    shape = _one_of(PLAIN, F.col("h"))
    fill = lambda acc, c: F.concat(acc, F.when(c == "9", F.substr(digits, F.pmod(F.length(acc) * 5 + 1, F.length(digits)).cast("int") + 1, F.lit(1))).when(c == "w", word).otherwise(c))
    value = F.aggregate(F.split(shape, ""), F.lit(""), fill)
    return rows.select("h", F.lit(0).alias("y"), _features(value, before, after).alias("x"))


def _fit(scanned: DataFrame, docs: DataFrame, text_col: str) -> tuple[Trees, float] | None:
    """Trees and the margin from which on a proposal is taken; None where the sample can't tell."""
    open_ = scanned.where(F.size("more") > 0).select("row", F.explode("more").alias("p")).where("not p.known and not p.maybe")
    open_ = open_.select(F.xxhash64("row", "p.start", "p.kind").alias("h"), F.lit(0).alias("y"), F.col("p.x").alias("x"))
    parts = (_variants(scanned), SAMPLE // 2), (open_, SAMPLE // 2), (_others(docs, text_col), SAMPLE // 2)
    seen = [part.orderBy("h", F.col("x").cast("string")).limit(most).collect() for part, most in parts]
    made = seen[0] + seen[2]
    if len(seen[0]) < LEAST or len(seen[2]) < LEAST:
        return None
    first = Trees(rounds=30, depth=4, least=4).fit(np.array([r["x"] for r in made]), np.array([r["y"] for r in made]))
    # a proposal that resembles the variants is no reliable 0: it may be what is looked for
    sure = first.margin(np.array([r["x"] for r in seen[1]])) < 0 if seen[1] else ()
    rows = sorted(made + [r for r, s in zip(seen[1], sure, strict=True) if s], key=lambda r: (r["h"], r["y"], r["x"]))
    y, x = np.array([r["y"] for r in rows]), np.array([r["x"] for r in rows])
    half = np.zeros(len(y), bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    trees = Trees(rounds=30, depth=4, least=4).fit(x[half], y[half])
    knots, values = isotonic(trees.margin(x[~half]), y[~half])
    good, less = knots[values >= PRECISION], knots[values < PRECISION]
    return (trees, float(good.min() + (less.max() if len(less) else good.min())) / 2) if len(good) else None


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """(doc_id, base, added): arrays of (start, rank, end, kind), base ones by kind, then start. With held, a column of
    docs, it and the text, empty where null, come too: what is made of the spans needs no join then."""
    keep = [] if held is None else ["text", "held"]
    scanned = common.settle(_scanned(docs, id_col, text_col, held), "personal-candidates")
    model = _fit(scanned, docs, text_col)
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string>>")
    if model is None:
        return scanned.select("doc_id", "base", none.alias("added"), *keep)
    trees, least = model
    wide = scanned.select("doc_id", "base", F.filter("more", lambda s: ~s["known"]).alias("open"), *keep)
    score = lambda s: trees.column([s["x"][k] for k in range(FEATURES)])
    taken = F.filter("open", lambda s: score(s) >= least)
    slim = F.transform(taken, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    wide = wide.select("doc_id", "base", F.when(F.size("open") > 0, slim).otherwise(none).alias("taken"), *keep)
    larger = lambda all_, s: F.exists(all_, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]) & ((t["end"] - t["start"] > s["end"] - s["start"]) | ((t["end"] - t["start"] == s["end"] - s["start"]) & (t["rank"] < s["rank"]))))
    return wide.select("doc_id", "base", let(F.col("taken"), lambda all_: F.filter(all_, lambda s: ~larger(all_, s))).alias("added"), *keep)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span's characters in text replaced by <kind>, all columns kept. Base spans come first; an added
    span never overlaps one, and of overlapping base spans the earlier, then longer, names the place."""
    names = docs.columns
    others = [c for c in names if c != text_col]
    held = F.struct(F.col(text_col).isNull().alias("empty"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(others)))
    found = find_personal_data(docs, id_col, text_col, held)
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    wide = found.select("text", "held", every.alias("spans"))
    text = F.col("text")
    piece = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct((-s["last"]).alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], -s["last"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"].cast("int") + 1, F.lit(2147483647))),
    )
    cleaned = F.when(F.size("spans") > 0, piece).when(~F.col("held.empty"), text)
    return wide.select(*((cleaned if c == text_col else F.col(f"held.c{others.index(c)}")).alias(c) for c in names))


def op6_personal_data(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    found = find_personal_data(docs if docs is not None else common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(how_many(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
        F.size(F.concat("base", "added")).cast("long").alias("n_spans"),
        F.size("added").cast("long").alias("n_added"),
    )
