"""The near-duplicate stage against exact Jaccard similarities, and which rows stay."""

import random

import pytest

from spanweave.llm import simhash


def shingles(text):
    return set(simhash.shingle_hashes(text, 5))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited_texts():
    """Bases of 200 words, each with edits that leave similarities from 0.6 to 1."""
    rnd = random.Random(3)
    texts = []
    for _ in range(40):
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for edits in (1, 3, 5, 7, 9):
            words = list(base)
            for at in rnd.sample(range(200), edits):
                words[at] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(words))
    return texts


def test_exactly_the_similar_are_linked(spark):
    texts = edited_texts()
    sets = [shingles(t) for t in texts]
    pairs = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}
    rows = simhash.cut(simhash.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 5))
    of = {r["node"]: r["doc_id"] for r in rows.collect()}
    got = {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in simhash.similar_sets(rows, 0.8).collect()}
    assert got == pairs and len(pairs) > 50


def test_a_large_group_of_near_copies_is_one(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(150)] + [" ".join(rnd.choice(base) for _ in range(300))]
    kept = simhash.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 150]


def near(words, at):
    return " ".join([*words[:at], "changed", *words[at + 1 :]])


def test_rows_without_an_id_or_with_a_repeated_one_are_judged_by_text(spark):
    rnd = random.Random(5)
    a, b, c, d, e, f = ([f"w{rnd.randrange(5000)}" for _ in range(150)] for _ in range(6))
    rows = [
        (None, " ".join(a)),
        (None, near(a, 20)),
        (None, " ".join(b)),
        (None, " ".join(c)),
        (None, " ".join(c)),
        (1, " ".join(d)),
        (2, near(d, 30)),
        (2, " ".join(e)),
        (3, " ".join(f)),
        (3, " ".join(f)),
        (3, near(b, 9)),
    ]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=repr)
    without = [t for i, t in kept if i is None]
    assert len(without) == 2 and " ".join(c) in without and len(set(without) & {" ".join(a), near(a, 20)}) == 1
    assert [k for k in kept if k[0] is not None] == sorted([(1, " ".join(d)), (2, " ".join(e)), (3, " ".join(f)), (3, near(b, 9))], key=repr)


def dense(seed, bases, copies, words, edits):
    """Copies of a few bases, each with its own random edits, so that similarities lie around 0.8."""
    rnd = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for at in rnd.sample(range(words), edits):
                text[at] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("case", [(1, 3, 60, 200, 3), (2, 1, 200, 100, 2), (3, 2, 90, 120, 2)])
def test_groups_around_the_similarity_equal_brute_force(spark, case):
    texts = dense(*case)
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    kept = simhash.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))
    assert 1 < len(set(root)) < len(texts)


def test_large_keys_lose_no_link(spark):
    """600 sets that meet under common keys and mostly lie just below the similarity: removals equal brute force."""
    texts = dense(4, 1, 600, 100, 2)
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    kept = simhash.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))
    assert 1 < len(set(root)) < len(texts)
