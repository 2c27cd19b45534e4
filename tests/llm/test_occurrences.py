"""Benchmark items that are copied whole, in part, edited or re-parameterised, each beside other occurrences."""

import pytest

from loomspan.llm.decontaminate import matches

FILLER = "before it stands quite another matter of no weight . {} . after it comes some further talk that means little"
NUMBERS = "the numbers 3, 5, 8, 13, 21, 34, 55, 89 and 144 in order"
APPLES = "Tom has 3 apples and 4 pears. Tom has 5 apples and 6 pears. Tom has 7 apples and 8 pears."
TRAIN = "a train leaves the town of Springfield at 60 km per hour and travels for 3 hours"
SIBLING = "a train leaves the town of Rivertown at 75 miles per hour and travels for 9 hours"
PLAIN = "seven grey herons walked along the muddy river bank while nobody in that quiet village cared to look at them twice"
STORY = "John bought 12 apples at the market. John sold 5 of them to a friend. Mary found 3 more near the gate. John gave her 2 plums for it. Mary kept 9 of all."
W = PLAIN.split()


def edited(*places):
    return " ".join("changed" if i in places else w for i, w in enumerate(W))


CASES = {
    "numbers": (NUMBERS, NUMBERS, "verbatim"),
    "repeats itself": (APPLES, APPLES, "verbatim"),
    "and a sibling": (TRAIN, TRAIN + " . so much for that one , and now for the next of them : " + SIBLING, "verbatim"),
    "sibling alone": (TRAIN, SIBLING, "reparameterised"),
    "one edit": (PLAIN, edited(10), "verbatim"),
    "two edits": (PLAIN, edited(7, 14), "verbatim"),
    "a word more": (PLAIN, " ".join(W[:9] + ["indeed"] + W[9:]), "verbatim"),
    "three quarters": (PLAIN, " ".join(W[: len(W) * 3 // 4]), "verbatim"),
    "lower case": (STORY, STORY.lower(), "verbatim"),
    "names first": (STORY, STORY.replace("John", "Maria").replace("12", "40").replace(" 5 ", " 17 ").replace(" ", "\n", 1), "reparameterised"),
    "a few words": (PLAIN, " ".join(W[:7]), None),
    "other numbers": (NUMBERS, "a table of 4, 6, 9, 14, 22, 35, 56, 90, 145, 12, 77, 31", None),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    names = list(CASES)
    items = spark.createDataFrame([(k, CASES[n][0]) for k, n in enumerate(names)], "item_id long, text string")
    docs = spark.createDataFrame([(k, FILLER.format(CASES[n][1])) for k, n in enumerate(names)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["verdict"] for r in matches(docs, items).collect()}
    return {n: got.get((k, k)) for k, n in enumerate(names)}


@pytest.mark.parametrize("name", CASES)
def test_occurrence(verdicts, name):
    assert verdicts[name] == CASES[name][2]
