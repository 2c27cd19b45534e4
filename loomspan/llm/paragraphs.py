"""Line and sentence dedup: units that repeat earlier ranked ones are removed, with their original offsets.

A line (up to and with its line feed) is cut into units after each sentence's end mark and the white space behind it, as
passages are often copied from and to the middle of a line; with unit="line" lines stay whole. Normalised, a unit is its
words in lower case, joined by single blanks and without marks at the words' ends; what has no word is no unit. Digests
are grouped over the corpus and the occurrence with the least (id, row, offset) stays. Later occurrences go if they weigh
enough: a run is a chain of repeated units with no other unit between them, and all units of a run of `min_words` words or
more are removed, however short each is. A lone phrase of a few words that recurs by chance, or is common, stays in a text;
min_words=1 removes it too.

Texts are scanned once for digests. Equal digests of one input partition are summed to the earliest before they are
shuffled. Digests that hold over a HEAVY-th of all units are at most HEAVY in number and are joined back by broadcast; the
rest, of which none is common, by a shuffle. Only texts that lose something are shuffled to meet their units.

Defined results: a null text is empty; a null id ranks after all others and stays null; rows with the same id rank by
their order in the settled table; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm import common
from loomspan.llm.spans import running_sum

#: Words of a run of repeated units from which on it is removed: half of a passage of 50 words.
MIN_WORDS = 25
HEAVY = 10_000
#: Rows that lose something: ids of up to so many (8 MB) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
LAST = (1 << 63) - 1
#: Where a unit ends: behind a line feed, and behind the white space after a sentence's end mark.
ENDS = {"line": r"(?<=\n)", "sentence": r"(?<=\n)|(?<=[.!?…][\x20\x09])(?=[^\s])|(?<=[。！？])"}
_SPACE, _MARKS = r"[\x20\x09-\x0D]+", r"[^\p{L}\p{N}]"


def _words(unit: Column) -> Column:
    return F.array_remove(F.split(F.lower(unit), rf"{_MARKS}*{_SPACE}{_MARKS}*|^{_MARKS}+|{_MARKS}+$", -1), "")


def _units(rows: DataFrame, unit: str) -> DataFrame:
    """(row, rank, k, start, end, n, a, b): the k-th unit of a row that has a word, its place, words and digests."""
    cut = rows.select("row", F.coalesce("doc_id", F.lit(LAST)).alias("rank"), F.split("text", ENDS[unit], -1).alias("units"))
    cut = cut.select("row", "rank", "units", running_sum(F.transform("units", lambda s: F.length(s).cast("long"))).alias("ends"))
    worded = F.filter(F.arrays_zip("units", "ends"), lambda u: u["units"].rlike(r"[\p{L}\p{N}]"))
    each = cut.select("row", "rank", F.posexplode(worded).alias("k", "u")).select("row", "rank", "k", F.col("u.units").alias("unit"), F.col("u.ends").alias("end"))
    told = each.select("row", "rank", "k", "end", F.length("unit").alias("size"), _words(F.col("unit")).alias("words"))
    joined = F.array_join("words", " ")
    return told.select("row", "rank", "k", (F.col("end") - F.col("size")).alias("start"), "end", F.size("words").alias("n"), F.xxhash64(joined).alias("a"), F.xxhash64(F.lit(1), joined).alias("b"))


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, unit: str = "sentence") -> tuple[DataFrame, DataFrame]:
    """docs as (row, doc_id, text), settled, and the units to remove as (row, start, end), in code points."""
    rows = common.settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")), "line-docs")
    units = common.settle(_units(rows, unit), "line-units")
    place = F.struct("rank", "row", "start")
    first = common.settle(units.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("of")).where("of > 1"), "line-first")
    most = units.count() // HEAVY
    heavy, light = first.where(F.col("of") > most), first.where(F.col("of") <= most)  # of > 1 / HEAVY of all: under HEAVY rows
    common_ = units.join(F.broadcast(heavy), ["a", "b"])
    rare = units.join(F.broadcast(heavy.select("a", "b")), ["a", "b"], "left_anti").join(light, ["a", "b"])
    again = common_.unionByName(rare).where(place != F.col("first")).select("row", "k", "start", "end", "n")
    if min_words <= 1:
        return rows, again.select("row", "start", "end")
    chained = again.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("row").orderBy("k")))
    heavy_enough = F.sum("n").over(Window.partitionBy("row", "run")) >= min_words
    return rows, chained.withColumn("goes", heavy_enough).where("goes").select("row", "start", "end")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, unit: str = "sentence") -> DataFrame:
    """(doc_id, text, kept_text, spans): removed units [start, end) in code points of the input, joined where they touch."""
    rows, units = repeated_units(docs, id_col, text_col, min_words, unit)
    of_row = common.settle(units.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("units")), "line-spans")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    if of_row.count() <= BROADCAST_ROWS:
        ids = F.broadcast(of_row.select("row"))
        cut = rows.join(ids, "row", "left_semi").join(of_row, "row").select("doc_id", "text", "units")
        whole = rows.join(ids, "row", "left_anti").select("doc_id", "text", F.col("text").alias("kept_text"), none.alias("spans"))
        return whole.unionByName(_cut(cut))
    return _cut(rows.join(of_row, "row", "left").select("doc_id", "text", F.coalesce("units", none).alias("units")))


def _cut(wide: DataFrame) -> DataFrame:
    """(doc_id, text, units) with the units, in order, taken out of the text."""
    heads = F.filter("units", lambda u, i: (i == 0) | (F.get("units", i - 1)["end"] < u["start"]))
    tails = F.filter("units", lambda u, i: F.coalesce(F.get("units", i + 1)["start"] > u["end"], F.lit(True)))
    wide = wide.withColumn("spans", F.transform(F.arrays_zip(heads.alias("h"), tails.alias("t")), lambda x: F.struct(x["h"]["start"].alias("start"), x["t"]["end"].alias("end"))))
    cuts = F.transform("spans", lambda s, i: F.struct(F.coalesce(F.get("spans", i - 1)["end"], F.lit(0).cast("long")).alias("a"), s["start"].alias("b")))
    pieces = F.transform(cuts, lambda c: F.substring(F.col("text"), c["a"].cast("int") + 1, (c["b"] - c["a"]).cast("int")))
    kept = F.concat(F.array_join(pieces, ""), F.substring("text", F.element_at("spans", -1)["end"].cast("int") + 1, F.lit(2147483647)))
    return wide.select("doc_id", "text", F.when(F.size("spans") > 0, kept).otherwise(F.col("text")).alias("kept_text"), "spans")


def _written(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept_text")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(remove_repeated_lines(common.table(spark, sf_dir, "documents")))


def op8_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that has a word is a unit, and goes however short it is."""
    return _written(remove_repeated_lines(common.table(spark, sf_dir, "documents"), min_words=1, unit="line"))
