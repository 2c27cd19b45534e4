"""Secrets in texts, told apart by how many owners hold them.

Base kinds are found by their formats. A further kind, `generic`, takes long runs of mixed letters and digits as
candidates. Each candidate's hash is counted over the corpus by distinct owner and repository: a secret of one owner
that looks random is live-looking, one that many owners hold is a copied example. Live-looking generic candidates become
spans as well; base spans always stay.

Only built-in functions: matches and offsets per text, then aggregates by (hash, owner) before (hash), so that a secret
that a third of all texts hold is summed before the shuffle, and its join back can be split.

Defined results: a null text is empty; null ids, owners and repositories are values like any other; repeated rows are
scanned one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common
from loomspan.llm.spans import how_many, places, written

# The formats of the base kinds, as the contract states them.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that may be keys of any other maker.
GENERIC = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"
#: A generic candidate looks random with so many distinct characters, of which some are digits, small and large letters.
DISTINCT = 14
#: Owners from which on a candidate counts as copied.
COPIED = 3
KINDS = ("assign", "access", "hex", "generic")


def _random(value: Column) -> Column:
    kinds = [value.rlike(p) for p in ("[0-9]", "[a-z]", "[A-Z]")]
    return kinds[0] & kinds[1] & kinds[2] & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(doc_id, spans): spans is an array of (start, rank, end, kind, digest, owners, repositories, verdict, base) in
    order of start, then kind; verdict is live, copied or shared."""
    owner = (F.col("source") if owner is None else owner).cast("string")
    repository = owner if repository is None else repository.cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), owner.alias("owner"), repository.alias("repository"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = rows.select(
        "*",
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)).alias("m0"),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)).alias("m1"),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)).alias("m2"),
        F.regexp_extract_all("text", F.lit(GENERIC), F.lit(0)).alias("m3"),
    )
    text = F.col("text")
    assign = F.when(F.size("m0") > 0, F.filter(places(text, ASSIGN, "assign", 0, F.col("m0"), F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))), lambda s: F.length(s["value"]) >= 6))
    empty = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string, value: string>>")
    generic = F.when(F.size(F.filter("m3", _random)) > 0, F.filter(places(text, GENERIC, "generic", 3, F.col("m3")), lambda s: _random(s["value"])))
    every = F.concat(F.coalesce(assign, empty), places(text, ACCESS, "access", 1, F.col("m1")), places(text, HEX, "hex", 2, F.col("m2")), F.coalesce(generic, empty))
    hashed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.md5(s["value"]).alias("digest")))
    base = common.settle(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", hashed.alias("candidates")), "secret-candidates")

    each = base.where(F.size("candidates") > 0).select("row", "owner", "repository", F.explode("candidates").alias("c"))
    by_owner = each.groupBy(F.col("c.digest").alias("digest"), "owner", "repository").agg(F.count("*").alias("n"))
    held = by_owner.groupBy("digest", "owner").agg(F.count("*").alias("r")).groupBy("digest").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    told = each.select("row", F.col("c.digest").alias("digest"), "c").join(held, "digest")
    verdict = F.when(F.col("owners") >= COPIED, "copied").when(F.col("owners") == 1, "live").otherwise("shared")
    span = F.struct("c.start", "c.rank", "c.end", "c.kind", "digest", "owners", "repositories", verdict.alias("verdict"), (F.col("c.rank") < 3).alias("base"))
    told = told.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    covered = lambda s, all_: F.exists(all_, lambda b: b["base"] & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    wanted = F.filter("spans", lambda s: s["base"] | ((s["verdict"] == "live") & ~covered(s, F.col("spans"))))
    out = base.select("row", "doc_id").join(told.select("row", wanted.alias("spans")), "row", "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast(told.schema["spans"].dataType)).alias("spans"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = docs if docs is not None else common.table(spark, sf_dir, "documents")
    found = find_secrets(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id",
        *(how_many(F.col("spans"), k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        of("live").alias("n_live"),
        of("copied").alias("n_copied"),
    )
