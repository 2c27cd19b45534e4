"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

A bounded sample of labelled documents (the SAMPLE least by hash of their id, of the rows that may be learned from) gives
a lexicon, the trees and the calibration. The lexicon is a list of fixed insults plus the words whose share of toxic
documents is the highest against chance. Features: densities of both lexicons, plain and after undoing obfuscation; how
near a second person stands to a hit; rates of capitals, marks, repeated marks and obfuscated words; lengths. Three
quarters of the sample fit the trees, the rest the calibration. Labels, language, source and id are no features.

Every whole text is scored in one pass without a shuffle; the model is the same at every size of input.

Defined results: null and empty texts are scored like any other; a null id is not held out and stays null; repeated rows
are scored one by one; of conflicting labels for an id the larger counts; without labels of both kinds every score is
the labelled share (0 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common
from loomspan.llm.gbt import Trees, isotonic

#: Labelled documents that the model is fitted on, and words in the learned lexicon.
SAMPLE = 20_000
LEXICON = 200
THRESHOLD = 0.3
NEAR = 4

# Insults, and words for the second person.
INSULTS = frozenset("idiot idiots moron morons scum trash pathetic worthless clown clowns stupid loser losers dumb fool fools garbage disgusting filth filthy vermin imbecile cretin hate idiota imbecil basura payaso tonto idioten dumm trottel abschaum müll imbécile crétin ordure débile".split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "-": "", "_": "", ".": "", "'": ""})
MARKS = ".,;:!?\"'()[]{}<>«»¡¿%&*$#|…-"

_REPEATED = re.compile(r"[!?]{2,}")
_SPACED = re.compile(r"\b(?:\w[ .\-_*]){3,}\w\b")
FEATURES = 17


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str, learned: dict[str, float]) -> list[float]:
    words = text.lower().split()
    n = len(words) or 1
    hits, weight, strongest, fixed, hidden, odd, you = [], 0.0, 0.0, 0, 0, 0, []
    seen = set()
    for i, w in enumerate(words):
        if not w.isalpha():
            w = w.strip(MARKS)
            if not w.isalpha() and w:
                plain = w.translate(LEET)
                if plain != w and plain.isalpha():
                    odd += 1
                    if plain in learned or plain in INSULTS:
                        hidden += 1
                        w = plain
        known = learned.get(w)
        if known is not None:
            weight += known
            strongest = max(strongest, known)
            seen.add(w)
            hits.append(i)
        if w in INSULTS:
            fixed += 1
            seen.add(w)
            if known is None:
                hits.append(i)
        elif w in YOU:
            you.append(i)
    for m in _SPACED.finditer(text):
        plain = re.sub(r"[ .\-_*]", "", m[0].lower())
        if plain in INSULTS or plain in learned:
            hidden += 1
            fixed += 1
    at = set(you)
    near = sum(1 for h in hits if any(h + k in at for k in range(-NEAR, NEAR + 1))) if at else 0
    chars = len(text) or 1
    upper = sum(map(text.count, filter(str.isupper, set(text))))
    loud = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    exclaim = text.count("!")
    return [
        len(hits) / n,
        float(len(hits)),
        weight / n,
        weight,
        strongest,
        fixed / n,
        float(fixed),
        float(len(seen)),
        hidden / n,
        odd / n,
        near / n,
        len(you) / n,
        upper / chars,
        loud / n,
        exclaim / chars,
        float(len(_REPEATED.findall(text))) / n,
        math.log1p(n),
    ]


def lexicon(sample: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """sample: (text, toxic). The words with the highest smoothed log odds of standing in a toxic document."""
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    each = sample.select("toxic", F.explode_outer(words).alias("word")).where("length(word) between 2 and 40")
    total = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = float(total["t"] or 0), float(total["n"] - (total["t"] or 0))
    counted = each.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where("t >= 3")
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    return {r["word"]: float(r["o"]) for r in counted.select("word", F.round(odds, 6).alias("o"), "t").where("o > 1").orderBy(F.desc(F.col("o") * F.log("t")), "word").limit(size).collect()}


def _featured(learned: dict[str, float]):
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, learned) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    return featured


class Model:
    """Lexicon, trees and calibration; `constant` where there was nothing to learn."""

    def __init__(self, learned: dict[str, float], x: np.ndarray, y: np.ndarray) -> None:
        self.learned, self.constant, self.trees = learned, float(y.mean()) if len(y) else 0.0, None
        fit = np.arange(len(y)) % 4 != 3
        if len(y) < 20 or y[fit].min() == y[fit].max() or not len(y[~fit]):
            return
        self.trees = Trees(rounds=80, depth=3).fit(x[fit], y[fit])
        self.knots, self.values = isotonic(self.trees.margin(x[~fit]), y[~fit])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.learned) for t in texts])
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # SAMPLE rows of two numbers
    rows = common.settle(docs.join(F.broadcast(taken), "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("h")), "toxic-sample")
    learned = lexicon(rows)
    got = common.map_arrow(rows.orderBy("h", "text").select("text", "toxic"), _featured(learned), "toxic int, x array<double>").collect()
    return Model(learned, np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float))


def _scorer(model: Model):
    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()))], names=["doc_id", "score"])

    return scorer


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of each row."""
    rows = common.texts(docs, id_col, text_col)
    return common.map_arrow(rows, _scorer(fit(rows, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), sample)), "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
