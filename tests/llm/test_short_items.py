"""Benchmark items with a short question, and short items."""

import random

import pytest

from spanweave.llm import decontamination

FILLER = "padding before and after the passage " * 5
ANSWER = " ".join(f"answer{i}" for i in range(20))


def found(spark, item, *texts):
    items = spark.createDataFrame([(7, item), (8, None), (9, " \n"), (10, "...")], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = {r["doc_id"] for r in decontamination.contaminated(docs, items).collect()}
    assert {r["doc_id"] for r in decontamination.decontaminated(docs, items).collect()} == set(range(len(texts))) - hits
    return hits


@pytest.mark.parametrize("n", range(3, 9))
def test_an_edit_inside_a_short_question(spark, n):
    question = [f"question{i}" for i in range(n)]
    edited = [*question[: n // 2], "other", *question[n // 2 + 1 :]]
    texts = [FILLER + " ".join(q) + "? " + ANSWER + " " + FILLER for q in (question, edited, ["nothing", "of", "it"])]
    assert found(spark, " ".join(question) + "? " + ANSWER, *texts) == {0, 1}


def test_short_items_are_found_by_all_their_words(spark):
    texts = [FILLER + "see Zinc melts, at (four) nineteen degrees. " + FILLER, "zinc melts at four degrees nineteen", "zinc melts at four nineteen", "", FILLER * 9 + "zinc melts at four nineteen degrees"]
    assert found(spark, "Zinc melts at four nineteen degrees", *texts) == {0, 4}


def test_words_scattered_over_a_long_text_are_no_hit(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(8)]
    filler = [word() for _ in range(6000)]
    scattered = list(filler)
    for k, w in enumerate(rnd.sample(item, 8)):
        scattered[300 + 700 * k] = w
    whole = filler[:2500] + item + filler[2500:]
    edited = filler[:2503] + item[:3] + [word()] + item[4:] + filler[2503:]
    long_item = " ".join(word() for _ in range(6000))
    texts = [" ".join(t) for t in (scattered, whole, edited, filler)] + [long_item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short = (1, " ".join(item))
    found = {}
    for name, items in (("alone", [short]), ("with a long one", [short, (2, long_item)])):
        rows = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        found[name] = sorted((r["doc_id"], r["item_id"]) for r in rows)
    assert found == {"alone": [(1, 1), (2, 1)], "with a long one": [(1, 1), (2, 1), (4, 2)]}


def test_every_place_of_an_item_lies_in_a_window():
    rnd = random.Random(4)
    item = [f"w{k}" for k in range(12)]
    for at in range(0, 90):
        words = [f"x{rnd.randrange(9)}" for _ in range(at)] + item + ["y"] * (95 - at)
        assert decontamination._best_place((item[:6], item[6:]), 12, words) == (1.0, 1.0)
