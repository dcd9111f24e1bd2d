"""The near-dedup stage against brute force on five-word shingles."""

import random

import corpus_pipeline
from callatlas.llm import similar


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def rows():
    r = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    out = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randrange(30, 200))]
        for _ in range(8):
            x = list(base)
            for _ in range(r.randrange(0, 6)):
                x[r.randrange(len(x))] = r.choice(words)
            out.append(" ".join(x))
    return out + ["a b c", "A b  c", "a b d", "", None, " \n"]


def test_stage_takes_five_words_and_a_similarity_of_four_fifths(spark):
    texts = rows()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(brute(texts)))


def test_links_are_the_same_in_chunks(spark):
    texts = rows()[:-3]
    members = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "root long, sid long, text string")
    for chunk in (3000, similar.CHUNK):
        root = list(range(len(texts)))
        for e in similar.links(members, chunk=chunk).collect():
            x, y = root[e["u"]], root[e["v"]]
            root = [min(x, y) if r in (x, y) else r for r in root]
        assert root == brute(texts)


def test_null_and_repeated_ids_lose_no_other_text(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (None, "seven eight nine ten eleven"), (None, "one two three four five six"), (4, "red green blue"), (4, "up down left right")], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted({r["text"] for r in docs.collect()})
