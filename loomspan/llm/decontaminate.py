"""Benchmark items in documents, also in part, edited, or with other numbers, names or units.

Both sides become template tokens: a number, a name (a capitalised word) and a unit (after a number) stand as typed
placeholders, other words in lower case; items are also read with their names as plain words, for copies in lower case.
Windows of five tokens are hashed and joined with their places, and matches on one diagonal (place in the document less
place in the item) form runs. An occurrence is one diagonal, or diagonals near each other, as inserted or dropped words
shift them; each token of the item is taken from the run that agrees best. It counts if it covers `SHARE` percent of the
item's tokens and of its plain words, or holds a run of `LONG` tokens that agree; items of under ten tokens count whole.
Each slot value of the item must stand for one value of the document, over that occurrence alone. The verdict is verbatim
if all values are equal, reparameterised if at least `percent` map consistently, else inconsistent, which is not
contamination; of an item's occurrences in a document the best verdict stands.

Only built-in functions. The item windows are broadcast up to a checked size and joined by a shuffle beyond; matches are
gathered by document, item and diagonal after that join, so that no document's windows are ever shuffled in the first case.

Defined results: null texts are empty; items of under five tokens carry no window and match nothing, as one to four words
by themselves stand in any text and would throw out clean documents; of items with the same
id the best matched text counts; null ids of documents stay null, repeated rows are matched one by one; empty tables give an empty
result; other columns are ignored, or kept by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm import common
from loomspan.llm.spans import let

WINDOW = 5
PERCENT = 80
SHARE, LONG = 50, 13
#: Diagonals that are further apart belong to different occurrences.
SLACK = 8
#: Item windows (24 bytes each) that may be broadcast.
BROADCAST_WINDOWS = 500_000
#: Documents with a match (8 bytes each) whose ids may be broadcast to the second scan.
BROADCAST_IDS = 1_000_000
# Units of measure that a slot may hold.
UNITS = "mm cm m km g kg mg t s ms min h l ml km/h mph % € $ £ usd eur euro euros dollar dollars meter meters metre metres kilometer kilometers mile miles hour hours minute minutes second seconds day days year years gram grams kilogram kilograms liter liters litre litres percent".split()

_NAME, _JOIN = "\u0002", "\u0003"


def tokens(text: Column) -> Column:
    """Words with names marked, and with the marks inside a number joined."""
    numbers = F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<=[0-9])[.,:/](?=[0-9])", _JOIN)).otherwise(text)
    named = F.regexp_replace(numbers, r"(?<![\p{L}\p{N}])(?=\p{Lu}\p{Ll})", _NAME)
    return F.array_remove(F.split(named, r"[^\p{L}\p{N}%€$£\x02\x03]+", -1), "")


def _is_number(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def _template(words: Column) -> Column:
    """Hashes of template tokens: 1 a number, 2 a name, 3 a unit."""
    return let(words, _hashed)


def _hashed(words: Column) -> Column:
    unit = lambda w, i: (i > 0) & w.isin(UNITS) & F.coalesce(_is_number(F.get(words, i - 1)), F.lit(False))
    return F.transform(
        words,
        lambda w, i: F.when(_is_number(w), F.lit(1).cast("long")).when(w.startswith(_NAME), F.lit(2).cast("long")).when(F.length(w) < 12, F.when(unit(F.lower(w), i), F.lit(3).cast("long")).otherwise(F.xxhash64(F.lower(w)))).otherwise(F.xxhash64(F.lower(w))),
    )


def _windows(template: Column) -> Column:
    return let(template, _rolled)


def _rolled(template: Column) -> Column:
    last = F.size(template) - WINDOW
    window = lambda i: F.xxhash64(*(F.get(template, i + k) for k in range(WINDOW)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)).otherwise(F.array().cast("array<long>"))


def _templated(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("words", tokens(F.col("text")))
    rows = rows.withColumn("template", _template(F.col("words")))
    return rows.withColumn("windows", _windows(F.col("template")))


def _unmarked(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), _NAME, "")


def _bank(items: DataFrame, text: Column) -> DataFrame:
    """(part, item_id, words, template, windows, plain) of each item's row; plain: the windows with names as plain words."""
    bank = _templated(items.select(F.monotonically_increasing_id().alias("part"), "item_id", text.alias("text")))
    bank = bank.withColumn("unmarked", F.transform("words", _unmarked)).withColumn("plain", _windows(_template(F.col("unmarked"))))
    return common.settle(bank.select("part", "item_id", F.col("unmarked").alias("words"), "template", "windows", "plain"), "benchmark")


def _aligned(lines: DataFrame, asked: DataFrame, theirs: DataFrame) -> DataFrame:
    """(row, part, d, t, begins, slot, asked, given, same, solid, length): tokens t of an item that lie in matched windows on
    diagonal d, with how many tokens their run has and how many of those agree."""
    covered = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + WINDOW - 1))))
    each = lines.select("row", "part", "d", "at", F.explode(covered).alias("t")).select("row", "part", "d", "t", F.array_contains("at", F.col("t")).alias("begins"), (F.col("t") + F.col("d")).alias("pos"))
    pairs = each.join(asked, ["part", "t"]).join(theirs, ["row", "pos"]).withColumn("same", F.col("asked") == F.col("given"))
    line = Window.partitionBy("row", "part", "d")
    pairs = pairs.withColumn("run", F.col("t") - F.row_number().over(line.orderBy("t")))
    run = Window.partitionBy("row", "part", "d", "run")
    return pairs.select("row", "part", "d", "t", "begins", "slot", "asked", "given", "same", F.sum(F.col("same").cast("long")).over(run).alias("solid"), F.count("*").over(run).alias("length"))


def _occurrences(tokens_: DataFrame, lines: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(row, item_id, n_windows, n_matched, rank) of the best occurrence of each item in a row: 0 verbatim, 1, 2."""
    order = Window.partitionBy("row", "part").orderBy("d")
    apart = F.coalesce((F.col("d") - F.lag("d").over(order) > SLACK).cast("long"), F.lit(0))
    bands = lines.select("row", "part", "d", apart.alias("apart")).withColumn("band", F.sum("apart").over(order))
    labels = bands.select("row", "part", "d", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("d").cast("long").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("band").alias("at")))).alias("label"))
    best = F.max(F.struct("solid", "length", "same", "slot", "asked", "given", "begins")).alias("b")
    picked = common.settle(tokens_.join(labels, ["row", "part", "d"]).groupBy("row", "part", "label", "t").agg(best).select("row", "part", "label", "b.*"), "benchmark-occurrences")
    key = ["row", "part", "label"]
    slots = picked.where("slot").groupBy(*key, "asked", "given").agg(F.count("*").alias("n")).groupBy(*key, "asked").agg(F.max("n").alias("most")).groupBy(*key).agg(F.sum("most").alias("most"))
    one = lambda c: F.sum(F.expr(c).cast("long"))
    sums = picked.groupBy(*key).agg(F.count("*").alias("covered"), one("not slot").alias("words"), one("slot").alias("slots"), one("slot and same").alias("same"), F.max("solid").alias("longest"), one("begins").alias("n_matched"))
    wide = sums.join(slots, key, "left").join(F.broadcast(sizes) if sizes.count() <= BROADCAST_WINDOWS else sizes, "part")
    enough = f"(n_tokens >= {2 * WINDOW} and 100 * covered >= {SHARE} * n_tokens and 100 * words >= {SHARE} * n_words and (words > 0 or same = slots)) or covered = n_tokens or longest >= {LONG}"
    rank = F.when(F.col("same") == F.col("slots"), 0).when((100 * F.col("most") >= percent * F.col("slots")) & (F.col("words") > 0), 1).otherwise(2)
    ranked = wide.where(enough).select("row", "item_id", "n_windows", "n_matched", rank.alias("rank"))
    return ranked.groupBy("row", "item_id").agg(F.min(F.struct("rank", (-F.col("n_matched")).alias("less"), "n_windows")).alias("b")).select("row", "item_id", "b.n_windows", (-F.col("b.less")).alias("n_matched"), "b.rank")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, numbered: bool = False) -> DataFrame:
    """(row, doc_id, item_id, n_windows, n_matched, verdict) of each document and item that share enough windows. row
    numbers the rows of docs, in a settled table, as they are read twice; with numbered, the ids are such numbers already."""
    bank = _bank(items, F.coalesce(F.col("text"), F.lit("")))
    keyed = lambda c: bank.select("part", F.posexplode(c).alias("i", "key"))
    keys = common.settle(keyed("windows").union(keyed("plain")).distinct(), "benchmark-windows")
    asked = bank.select("part", F.posexplode(F.arrays_zip(F.col("template").alias("t"), F.col("words").alias("w"))).alias("t", "x")).select("part", "t", F.col("x.t").between(1, 3).alias("slot"), F.col("x.w").alias("asked"))
    sizes = bank.select("part", "item_id", F.size("words").cast("long").alias("n_tokens"), F.size("windows").cast("long").alias("n_windows"), F.size(F.filter("template", lambda t: ~t.between(1, 3))).alias("n_words"))
    text = F.coalesce(text_col, F.lit("")).alias("text")
    if numbered:
        rows = docs.select(F.col(id_col).alias("row"), F.col(id_col).alias("doc_id"), text)
    else:
        rows = common.settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text), "benchmark-rows")
    each = _templated(rows).select("row", "doc_id", F.posexplode_outer("windows").alias("j", "key"))
    few = keys.count() <= BROADCAST_WINDOWS
    hits = each.join(F.broadcast(keys) if few else keys, "key").groupBy("row", "doc_id", "part", (F.col("j") - F.col("i")).alias("d")).agg(F.sort_array(F.collect_set("i")).alias("at"))
    hits = common.settle(hits, "benchmark-hits")
    # a matched window covers five tokens at most, and a run of LONG tokens has LONG - 4 windows
    total = hits.groupBy("row", "part").agg(F.sum(F.size("at")).alias("n")).join(sizes.select("part", "n_tokens"), "part")
    total = total.where(f"100 * {WINDOW} * n >= {SHARE} * n_tokens or n > {LONG - WINDOW}").select("row", "part")
    lines = common.settle(hits.join(total, ["row", "part"], "left_semi"), "benchmark-matches")

    ids = lines.select("row").distinct()
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    theirs = rows.select("row", "text").join(wanted, "row", "left_semi").select("row", F.posexplode(tokens(F.col("text"))).alias("pos", "w")).select("row", "pos", _unmarked(F.col("w")).alias("given"))
    best = _occurrences(_aligned(lines, asked, theirs), lines, sizes, percent)
    verdict = F.element_at(F.array(F.lit("verbatim"), F.lit("reparameterised"), F.lit("inconsistent")), F.col("rank") + 1)
    return best.join(lines.select("row", "doc_id").distinct(), "row").select("row", "doc_id", "item_id", "n_windows", "n_matched", verdict.alias("verdict"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that hold no benchmark item."""
    names = docs.columns
    held = common.settle(docs.select(F.monotonically_increasing_id().alias("n"), F.struct(*(F.col(c) for c in names)).alias("d")), "decontaminate-docs")
    found = matches(held.select("n", F.col("d.text").alias("text")), items, "n", numbered=True)
    bad = common.settle(found.where("verdict <> 'inconsistent'").select(F.col("doc_id").alias("n")).distinct(), "decontaminate-bad")
    few = bad.count() <= BROADCAST_IDS
    return held.join(F.broadcast(bad) if few else bad, "n", "left_anti").select(*(F.col(f"d.{c}").alias(c) for c in names))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item."""
    found = matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.where("verdict <> 'inconsistent'").select("doc_id", "item_id", "n_windows", "n_matched", "verdict")
