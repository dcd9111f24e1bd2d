"""op11, op12 and op13 against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from callatlas.llm import families, lexical, minhash, variants


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- op11


def ranked(docs, queries, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in queries:
        found = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // length
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(term.findall(lower(text))) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def search_rows():
    r = random.Random(11)
    words = [f"w{k}" for k in range(40)] + ["über", "Straße", "x_y", "A-b", "日本", "it's", "42"]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.choice((1, 5, 5, 9, 30, 80))))) for k in range(300)]
    docs += [(500, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (501, None), (502, ""), (503, " .,- "), (None, "w1 w2 w3"), (504, "w7 " * 30000)]
    queries = [(k, " ".join(r.choice(words) for _ in range(r.choice((1, 3, 12, 60))))) for k in range(25)] + [(90, None), (91, ""), (92, "unknown"), (93, "W1 w1 W1!")]
    return docs, queries


@pytest.mark.parametrize("shard,block", [(10**6, 10**6), (150, 20)])
def test_ranks_are_brute_force(spark, shard, block):
    docs, queries = search_rows()
    d = spark.createDataFrame([(*x, 1, "n") for x in docs], "doc_id long, text string, score int, m string")
    q = spark.createDataFrame([(*x, 2) for x in queries], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in lexical.search(d, q, shard=shard, block_terms=block).collect()), key=str)
    assert got == ranked(docs, queries)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, q).collect() == [] and lexical.search(some, q.limit(0)).collect() == []


def test_strata_under_the_kth_score_are_not_visited():
    r = np.random.default_rng(5)
    n = 20000
    m = r.integers(10, 400, n)
    at, term, tf = np.arange(n), np.zeros(n, np.int64), r.integers(1, 4, n)
    s = lexical.Shard(np.arange(n), m, term, tf, at, np.array([700]))
    want = 700 * ((10**9 * tf) // (1000 * tf + 8 * m))
    seen = []
    whole, lexical._ranges = lexical._ranges, lambda a, z: seen.append(int((z - a).sum())) or whole(a, z)
    try:
        score, doc = s.search(np.array([0]), 10, 0, step=64)
    finally:
        lexical._ranges = whole
    order = np.lexsort((np.arange(n), -want))[:10]
    assert doc.tolist() == order.tolist() and score.tolist() == want[order].tolist() and sum(seen[1:]) < n / 4


# --- op12


def sets_of(text, k=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    return frozenset(" ".join(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)) if w else frozenset()


def linked(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None)))
    return sorted(out, key=str)


def copies(seed=12, families_=10, each=12):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(families_):
        base = [r.choice(words) for _ in range(r.randrange(20, 160))]
        for _ in range(each):
            x = list(base)
            for _ in range(r.randrange(0, 1 + len(x) // 25)):
                x[r.randrange(len(x))] = r.choice(words)
            out.append(" ".join(x))
    r.shuffle(out)
    rows = [(k + 10, t) for k, t in enumerate(out)]
    return [*rows, (3, rows[7][1]), (3, rows[7][1]), (None, rows[8][1].upper()), (1, "a b c"), (2, "A b  c"), (4, "a b d"), (5, ""), (6, None), (7, " \n"), (8, "ÄB c"), (9, "äb c"), (None, "quite alone"), (900, "z y x " * 9000)]


@pytest.mark.parametrize("chunk", [900, 1_000_000])
def test_components_are_brute_force(spark, chunk, monkeypatch):
    rows = copies()
    whole = families.resolve
    monkeypatch.setattr(minhash, "resolve", lambda *a: whole(*a, chunk=chunk))
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, n int, sid string")
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str) == linked(rows)


def test_no_rows_no_components(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimates_are_near_the_similarity():
    r = np.random.default_rng(2)
    off = []
    for _ in range(200):
        n, common = 400, int(r.integers(0, 400))
        h = r.integers(0, 2**63, 2 * n - common).astype(np.uint64)
        a, b = h[:n], h[n - common :]
        s = [np.frombuffer(minhash.signature(minhash.minima(x)), np.uint64)[None] for x in (a, b)]
        off.append(minhash.estimate(*s)[0] - common / (2 * n - common))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.06


def test_a_family_around_one_text_makes_no_pairs(spark):
    """One text with one word replaced in each copy: copies link to the text itself, so no set is left to meet others."""
    r = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        x = list(base)
        x[k] = f"n{r.random()}"
        rows.append((k, " ".join(x)))
    made = []
    whole = families.across
    families.across = lambda *a: made.append(whole(*a)) or made[-1]
    try:
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        families.across = whole
    assert {x["component_id"] for x in got} == {0} and [m.count() for m in made] == [0]


# --- op13


def brute_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(n):
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if one_edit(w, v)]
        top = min(((-n[v], v) for v in near[w]), default=None)
        form[w] = top[1] if top and -top[0] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def spelt():
    r = random.Random(13)
    letters = "abcdéßÿ"
    words = ["".join(r.choice(letters) for _ in range(r.randrange(7, 13))) for _ in range(60)]
    for w in list(words):
        for _ in range(4):
            k = r.randrange(len(w))
            words.append(r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :])))
    n = Counter({w: r.choice((2, 3, 25, 40, 400)) for w in words if len(w) >= 5})
    return n


@pytest.mark.parametrize("chunk", [3, 4096])
def test_near_words_are_brute_force(spark, chunk):
    n = spelt() + Counter({"aaaaaaa": 2, "aaaaaaaa": 2, "aaaaaaaaa": 30, "aaaabaaa": 2, "naïveté" * 9: 5, "naïveté" * 8 + "naïvet": 60})
    v = spark.createDataFrame(list(n.items()), "word string, n long")
    got = sorted((r["word"], r["near"], r["near_n"]) for r in variants.near_words(v, chunk=chunk).collect())
    assert got == sorted((a, b, n[b]) for a in n for b in n if one_edit(a, b))


def test_forms_and_roots_are_brute_force(spark):
    n = spelt()
    got = sorted(tuple(r) for r in variants.forms(spark.createDataFrame(list(n.items()), "word string, n long")).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == brute_forms(n) and any(a[5] != a[3] for a in got if a[3])


def test_words_of_texts(spark):
    r = random.Random(1)
    n = spelt()
    docs = [(k, " ".join(r.choice((w, w.upper(), w + "-" + w, "(" + w + ")", "日" + w)) for w in r.sample(sorted(n), 30))) for k in range(40)]
    docs += [(None, "nothing nothing nothing"), (7, docs[7][1]), (90, None), (91, ""), (92, "ÀÉÎÕÜÀÉ àéîõüàé ×÷×÷×÷× ×÷×÷×÷×"), (93, "longword " * 50000), (94, "x" * 100000 + " " + "x" * 100000)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, word int")
    assert {r["word"]: r["n"] for r in variants.words(d).collect()} == brute_words(docs)


def test_no_texts_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.forms(variants.words(none)).collect() == []
