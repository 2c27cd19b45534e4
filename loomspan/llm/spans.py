"""Places of regular-expression matches, with built-in functions only.

`split` by a pattern gives the gaps between its matches and `regexp_extract_all` the matches; running sums of their
lengths are the offsets, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's own expressions are computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sum(lengths: Column) -> Column:
    """Running sums of an array of longs. Two levels, so that an array of n costs n * 128 steps, not n * n."""
    return let(lengths, _running_sum)


def _running_sum(lengths: Column) -> Column:
    zero = F.lit(0).cast("long")
    n_blocks = F.ceil(F.size(lengths) / F.lit(_BLOCK)).cast("int")
    block = lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    blocks = F.sequence(F.lit(0), n_blocks - 1)
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), zero, lambda acc, x: acc + x))
    base = F.aggregate(sums, F.array(zero), grow)
    one_by_one = let(base, lambda at: F.flatten(F.transform(blocks, lambda b: F.slice(F.aggregate(block(b), F.array(F.element_at(at, b + 1)), grow), 2, _BLOCK))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<long>")).when(F.size(lengths) <= _BLOCK, F.slice(F.aggregate(lengths, F.array(zero), grow), 2, _BLOCK)).otherwise(one_by_one)


def places(text: Column, pattern: str, kind: str, rank: int, matches: Column, values: Column | None = None) -> Column:
    """array<struct<start, rank, end, kind, value>> of the matches, which the caller has extracted by the same pattern."""
    gaps = F.split(text, pattern, -1)
    sizes = F.transform(matches, lambda m: F.length(m).cast("long"))
    ends = running_sum(F.zip_with(sizes, F.slice(gaps, 1, F.greatest(F.size(matches), F.lit(1))), lambda m, g: m + F.length(g)))
    rows = F.transform(
        F.arrays_zip(ends.alias("e"), matches.alias("m"), (matches if values is None else values).alias("v")),
        lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")),
    )
    return F.when(F.size(matches) > 0, rows).otherwise(F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string, value: string>>"))


def written(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def how_many(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
