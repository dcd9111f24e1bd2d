"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import datetime
import hashlib
import io
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from callatlas.llm import common, counts, covertree, lines, mixing, pii, quality, simhash, similar, toxicity, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def make_docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, source string" + extra)


def base_rows():
    r = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "über", "x1", "42", "zeta"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 60))), r.choice(["a", "b", None])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, " \n\t ", None), (103, "same text here " * 9, "a"), (104, "same text here " * 9, "a"), (None, "no id at all", "b"), (5, rows[5][1], rows[5][2]), (106, "long " * 20000, "a")]
    return rows


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}


def test_words_are_split_at_ascii_space_only():
    w, rows = common.split_words(pa.array(["a b c", None, "", "\x0bd\n"]))
    assert (w.to_pylist(), rows.tolist()) == (["a b", "c", "d"], [0, 0, 3])


# --- op1


def test_archives_round_trip(spark, tmp_path):
    big = "<html>" + "é" * 600
    pages = [(1, "u1", big), (2, "u2", big), (3, "u3", "short"), (4, "u4", "short"), (5, None, None), (6, "u\r\n6", ""), (None, "n", big), (2, "u1b", big), (2, "u2", big)]
    df = warc.with_revisits(spark.createDataFrame(pages, "page_id long, url string, html string"))
    folder = str(tmp_path / "w")
    listed = spark.createDataFrame(warc.write(df, folder).collect(), "path string, records long, bytes long")
    got = sorted(warc.read(listed, folder).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["url"]))
    want = [(1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (2, "revisit", 2), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 2)]
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == want and got[1]["url"] == "u1b"
    for r in got:
        html = next(h for i, _, h in pages if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        assert r["payload"] == (None if r["record_type"] == "revisit" else html.encode())


def test_broken_records_are_refused():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"WARC-Type", b"WARC-Tipe"), b""):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"\x28\xb5\x2f\xfd")))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(warc.dictionary_frame(b"<html>")[:-2])))


# --- op3


@pytest.mark.parametrize("shard,block", [(40, 3), (1000, 1000)])
def test_top_k_is_brute_force(spark, shard, block):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(200, 6)) * 0.3, 2)
    x[50:60] = x[0]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(200)]
    rows += [(400, None), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (440, [float("nan")] * 6), (460, [float("inf")] * 6), (3, [float(v) for v in x[3]]), (480, [0.5, 0.5]), (7000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for q in covertree.top_k(covertree.vectors(df), k=20, shard=shard, block=block).collect():
        got.setdefault(q["query_id"], {})[q["rank"]] = (q["vec_id"], q["score"])
    v = [(i, [int(np.floor(64 * c)) for c in e]) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    for i, q in v:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in v if j != i and len(c) == len(q))[:20]
            want = {k + 1: (j, -s) for k, (s, j) in enumerate(best)}
            assert got.get(i, {}) == want, i


def test_cover_tree_covers_and_separates():
    x = np.random.default_rng(0).normal(size=(500, 8))
    todo = [covertree.cover_tree(x, 20)]
    seen = []
    while todo:
        n = todo.pop()
        todo += n.children
        if n.rows is not None:
            seen += n.rows.tolist()
            assert np.sqrt(((x[n.rows] - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-9
        if n.children:
            c = np.stack([y.centre for y in n.children])
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + np.eye(len(c)) * 1e9
            assert apart.min() >= max(y.radius for y in n.children) - 1e-9 and max(y.radius for y in n.children) < n.radius
            assert (np.abs(c - n.centre).sum(1) < 1e-9).any()  # a node's centre is a child's too
    assert sorted(seen) == list(range(500))


def clustered(n, dims, groups, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    centres *= 64 / np.sqrt((centres**2).sum(1))[:, None]
    return np.floor(centres[r.integers(groups, size=n)] + r.normal(size=(n, dims)))


def test_node_pairs_are_pruned_on_clustered_vectors():
    x = clustered(8192, 32, 60)
    ids = np.arange(len(x))
    q = ids % 20 == 0
    top = covertree.Top(int(q.sum()), 20)
    told = covertree.search(x[q], ids[q], x, ids, covertree.cover_tree(x, 128), top)
    assert told["pruned"] > 0 and told["scored"] < 0.4 * q.sum() * len(x)
    s = x[q] @ x.T
    s[np.arange(q.sum()), ids[q]] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :20]
    assert (top.id == want).all()


@pytest.mark.parametrize("groups,dims,most", [(400, 64, 0.05), (400, 384, 0.1), (1, 64, 1.1)])
def test_few_pairs_are_scored_where_groups_are_many(groups, dims, most):
    x = clustered(16384 if groups > 1 else 1500, dims, groups, seed=2)
    ids = np.arange(len(x)) % 1200 if groups == 1 else np.arange(len(x))  # repeated ids too
    q = np.arange(len(x)) % 20 == 0
    top = covertree.Top(int(q.sum()), 20)
    told = covertree.search(x[q], ids[q], x, ids, covertree.cover_tree(x, covertree.LEAF), top)
    assert told["scored"] < most * q.sum() * len(x) and told["pruned"] > 0
    s = x[q] @ x.T
    s[ids[q][:, None] == ids[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :20]
    assert (top.id == ids[order]).all() and (top.score == np.take_along_axis(s, order, 1)).all()


def test_queries_go_only_to_cells_that_can_matter(spark):
    x = clustered(4000, 16, 40, seed=3)
    v = pa.array([[int(c) for c in row] for row in x], pa.list_(pa.int64()))
    cells = covertree.Cells(pa.array(range(len(x))), v, 40)
    cell, far = cells.of(x)
    for c in np.unique(cell):
        cells.first[c], cells.parts[c], cells.radius[c] = int(c), 1, far[cell == c].max()
    s = x[:200] @ x.T
    kth = -np.sort(-s, axis=1)[:, 19]
    sent = sum(len(rows) for rows, _ in cells.reached(x[:200], kth))
    assert sent < 0.5 * 200 * len(cells.first)
    for rows, c in cells.reached(x[:200], kth):
        left_out = np.setdiff1d(np.arange(200), rows)
        assert not (s[left_out][:, cell == c] >= kth[left_out][:, None]).any()


# --- op5


def brute_statistics(text):
    ws = WORDS.findall(text or "")
    win = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    mark = set()
    for i in range(len(ws) - 4):
        if win[tuple(ws[i : i + 5])] > 1:
            mark |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(mark))


def test_statistics_are_brute_force(spark):
    rows = base_rows() + [(200, "a b c d e f a b c d e g\nx\nx\n\n\n#*|<>é é", "a"), (201, "a a a a a a a", "b"), (202, "one\ntwo\none\n \n ", None)]
    got = quality.with_statistics(make_docs(spark, rows)).collect()
    assert Counter((r["doc_id"], *[r[k] for k in quality.STATS]) for r in got) == Counter((i, *brute_statistics(t)) for i, t, _ in rows)


def test_forest_tells_outliers_and_keeps_good_documents(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(80)), "a") for i in range(150)] + [(1000 + i, " ".join(r.choice(vocabulary) + "###***" for _ in range(80)), "a") for i in range(8)]
    labels = spark.createDataFrame([(i, 0 if i >= 1000 else 1) for i, _, _ in rows] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = {x["doc_id"]: x["kept"] for x in quality.judge(make_docs(spark, rows), labels).collect()}
    assert sum(not got[i] for i in range(150)) <= 2 and not any(got[1000 + i] for i in range(8))
    assert quality.judge(make_docs(spark, rows[:3]).limit(0), labels).count() == 0


# --- op6


def test_truncated_totals_are_brute_force(spark):
    rows = base_rows()
    n = counts.lengths(make_docs(spark, rows)).cache()
    h = counts.suffix_sums(counts.histogram(n), shift=3)
    by = defaultdict(list)
    for x in n.collect():
        by[x["source"]].append(x["n_tokens"])
    for a in counts.answers(h).collect():
        own = by[a["source"]]
        assert (a["docs"], a["docs_ge"], a["source_docs"], a["source_tokens"]) == (own.count(a["limit"]), sum(v >= a["limit"] for v in own), len(own), sum(own))
        assert a["tokens_truncated"] == sum(min(v, a["limit"]) for v in own)
    for t in counts.truncated_totals(h, (0, 7, 50, 10**6)).collect():
        assert t["tokens"] == sum(min(v, t["limit"]) for v in by[t["source"]])
    for q in counts.quantiles(h, (0.5,)).collect():
        own = sorted(by[q["source"]])
        assert q["n_tokens"] == own[-(-len(own) // 2) - 1]


# --- op7


TEXT = "call +1 (974) 555-3436 or und.34@mail7.example.com from 97.51.17.173 on 2024-02-29, 31.12.1999, 30.02.2001, 300.1.1.1 card 4111 1111 1111 1111 and 4111111111111112 ssn 219-09-9999 DE89 3704 0044 0532 0130 00 end"


def test_pseudonyms_keep_format_link_equal_values_and_can_be_undone(spark):
    rows = [(1, TEXT, "a"), (2, "again 4111-1111-1111-1111 and 97.51.17.173", "a"), (3, None, None), (4, "", "b"), (5, "1234", "b"), (1, TEXT, "a")]
    d = make_docs(spark, rows)
    p = pii.pseudonymised(d, "k1")
    got = p.collect()
    new = [r["text"] for r in got if r["doc_id"] == 1][0]
    assert new != TEXT and re.sub(r"[0-9]", "9", new.replace("vno", "und")).count("9") > 40
    assert "30.02.2001" in new and "300.1.1.1" in new and "4111111111111112" in new
    digits = re.search(r"card ([\d ]{19})", new)[1].replace(" ", "")
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits))
    assert total % 10 == 0
    other = next(r["text"] for r in got if r["doc_id"] == 2)
    assert re.search(r"[\d-]{19}", other)[0].replace("-", "") == digits and re.search(r"from (\S+)", new)[1] in other
    back = {(r["doc_id"], r["text"]) for r in pii.pseudonymised(p, "k1", back=True).collect()}
    assert back == {(i, t) for i, t, _ in rows}
    assert pii.pseudonymised(d, key="other").where("doc_id = 1").first()["text"] != new


def test_no_text_is_slow_or_deep_for_the_patterns(spark):
    texts = ["a" * 1_000_000 + " @", "a@" + "b." * 100_000 + "com", "1" * 1_000_000, "1 " * 200_000, "a@" * 200_000, "+1 " * 100_000, "x" * 65 + "@b.com", "010.01.1.1 1.2.3.4"]
    began = time.time()
    got = [r["text"] for r in pii.pseudonymised(make_docs(spark, [(k, t, "a") for k, t in enumerate(texts)]), "k'1\\").orderBy("doc_id").collect()]
    assert time.time() - began < 60 and got[:1] == texts[:1] and got[6] == texts[6]
    assert got[7].startswith("010.01.1.1 ") and got[7] != texts[7]


def test_clashing_columns_stay(spark):
    names = ["parts", "new", "between", "row", "t", "doc_key", "drops", "key", "size", "b_source", "mix_flag", "tox_key", "near_key", "a.b"]
    d = make_docs(spark, [(1, "one line of words\nmail a@b.com", "a"), (None, None, None), (2, "", "b")])
    for k, n in enumerate(names):
        d = d.withColumn(n, F.lit(k))
    kept = lambda out: sorted(tuple(r[n] for n in names) for r in out.collect())
    want = [tuple(range(len(names)))] * 3
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for out in (pii.pseudonymised(d, "k"), lines.dedup(d, short=True), mixing.mix(d), toxicity.without_toxic(d, labels)):
        assert kept(out) == want
    assert kept(simhash.keep_one(d)) == want[:2] and kept(similar.keep_one(d)) == want[:2]


def feistel(left, right, a, b, tweak, key):
    """The permutation in plain Python."""
    for i in range(pii.ROUNDS):
        h = int(hashlib.sha256(f"{key}|{tweak}|{i}|{right if i % 2 == 0 else left}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + h % a) % a
        else:
            right = (right + h % b) % b
    return left, right


def moved(digits, tweak, key):
    n = len(digits) // 2
    x, y = feistel(int(digits[:n] or 0), int(digits[n:] or 0), 10**n, 10 ** (len(digits) - n), f"{tweak}{len(digits)}", key)
    return (str(x).zfill(n) if n else "") + str(y).zfill(len(digits) - n)


def brute_pseudonym(m, key):
    """The pseudonym of a card number, address of four parts or date that is valid, else the match."""
    digits = re.sub(r"\D", "", m)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", m):
        try:
            day = (datetime.date.fromisoformat(m) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return m
        x, y = feistel(day // 319, day % 319, 229, 319, "date", key)
        return (datetime.date(1900, 1, 1) + datetime.timedelta(x * 319 + y)).isoformat() if 0 <= day < 73051 else m
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = m.split(".")
        if any(int(x) > 255 or (x[0] == "0" and x != "0") for x in o):
            return m
        a, b, c, e = map(int, o)
        x, y = feistel(a * 256 + b, c * 256 + e, 65536, 65536, "ipv4", key)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    check = lambda d: str(-sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10)
    if not 13 <= len(digits) <= 19 or check(digits[:-1]) != digits[-1]:
        return m
    body = moved(digits[:-1], "card", key)
    new = iter(body + check(body))
    return "".join(next(new) if c.isdigit() else c for c in m)


def test_pseudonyms_are_brute_force_on_documents(spark):
    key = hashlib.sha256(b"k2").hexdigest()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(make_docs(spark, [(10**6 + k, t, "a") for k, t in enumerate(["10.0.0.1 on 2024-02-29 with 4111 1111 1111 1111, 2023-02-29, 256.1.1.1", "4111111111111111 4111-1111-1111-1112 0.0.0.0 1899-12-31"])]))
    want = Counter()
    for r in docs.collect():
        for m in re.finditer(pii.ANY, r["text"] or "", re.ASCII):
            if (kind := brute_kind(m[0])) in ("card", "ipv4", "date"):
                want[r["doc_id"], kind, brute_pseudonym(m[0], key)] += brute_pseudonym(m[0], key) != m[0]
    text = {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs, "k2").collect()}
    assert sum(want.values()) >= 5
    for (i, _, new), n in want.items():
        assert not n or new in text[i], (i, new)
    found = Counter((r["doc_id"], x["kind"]) for r in pii.pseudonymised(docs, "k2").collect() for x in r["pii_found"] if x["kind"] in ("card", "ipv4", "date"))
    for (i, kind, _), n in want.items():
        assert not n or found[i, kind] >= 1


def brute_kind(m):
    if "@" in m:
        return "email"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", m):
        return "date"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        return "ipv4"
    return "card" if re.fullmatch(r"[\d -]+", m) and 13 <= len(re.sub(r"\D", "", m)) <= 19 else None


def test_feistel_is_a_permutation(spark):
    d = spark.range(91).selectExpr("id div 13 as l", "id % 13 as r")
    x = d.withColumn("s", F.expr(pii.feistel("l", "r", "7", "13", "k", "'t'")))
    assert x.selectExpr("s.l", "s.r").distinct().count() == 91
    assert x.withColumn("b", F.expr(pii.feistel("s.l", "s.r", "7", "13", "k", "'t'", back=True))).where("b.l <> l or b.r <> r").count() == 0


# --- op8


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**out, **share}
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over


def test_mix_meets_targets(spark):
    rows = base_rows() + [(1000 + i, "w " * (i % 30), "tiny" if i < 3 else "big") for i in range(600)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mix_level int")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want, taken, largest = brute_targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert abs(r["mix_target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and 0 <= r["mix_copies"] <= 3
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
        largest[r["source"]] = max(largest[r["source"]], r["mix_size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= 3 * largest[s] + 0.05 * want[s], s
    assert Counter(map(tuple, mixing.mix(d).collect())) == Counter(map(tuple, got))
    assert mixing.emit(mixing.mix(d)).count() == sum(r["mix_copies"] for r in got)
    assert mixing.mix(d.limit(0)).count() == 0


# --- op9


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def brute_dedup(rows):
    occ, docs = [], {}
    for i, t in {(i, t) for i, t, *_ in rows if t is not None}:
        key = hashlib.md5(f"{'null' if i is None else i}|{t}".encode()).digest()
        docs[i, t] = key
        occ += [((i is None, i if i is not None else 0, key, p), x, (i, t)) for p, x in enumerate(t.split("\n")) if len(x) >= 10]
    drop = defaultdict(set)
    for place, x, doc in occ:
        if any(q < place and abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2 for q, y, _ in occ):
            drop[doc].add(place[3])
    return {(i, t): "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop[i, t]) for i, t in docs}


def test_line_dedup_is_brute_force(spark):
    r = random.Random(5)
    pool = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(6, 40))) for _ in range(25)]

    def vary(x):
        x = list(x)
        for _ in range(r.randrange(4)):
            p, k = r.randrange(len(x)), r.randrange(3)
            x[p : p + (k != 0)] = [] if k == 1 else [r.choice("abcdeé")]
        return "".join(x) or "x"

    rows = [(i, "\n".join(vary(r.choice(pool)) for _ in range(r.randrange(1, 8))), "a") for i in range(40)]
    rows += [(50, None, "a"), (51, "", "a"), (None, pool[3] + "\n" + pool[4], "b"), rows[0], (52, "z" * 3000 + "\n" + "z" * 3001, "a")]
    want = brute_dedup(rows)
    got = lines.dedup(make_docs(spark, rows)).collect()
    by = Counter((x["doc_id"], x["text"]) for x in got)
    assert by == Counter((i, None if t is None else want[i, t]) for i, t, _ in rows)
    assert lines.dedup(make_docs(spark, rows).limit(0)).count() == 0


# --- op10


def brute_fingerprint(text):
    ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")]
    if not ws:
        return 0
    k = min(3, len(ws))
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + k]).encode(), 42) for i in range(len(ws) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    ids = {i: fp for i, fp in pairs}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if bin(ids[a] ^ ids[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_are_brute_force(spark):
    rows = [x for x in base_rows() if x[0] is not None]
    rows += [(300 + i, " ".join(["word%d" % k for k in range(200)] + [f"t{i}"]), "a") for i in range(12)]
    got = simhash.near_duplicates(make_docs(spark, rows)).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows])
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == Counter((i, brute_fingerprint(t), want[i]) for i, t, _ in rows)
    kept = simhash.keep_one(make_docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_comparison_is_exact(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2**63, 6).astype(np.uint64)
    fps, groups = [], []
    for g in range(5):
        for _ in range(int(r.integers(1, 150))):
            x = int(base[r.integers(6)])
            for b in r.integers(0, 64, int(r.integers(0, 4))):
                x ^= 1 << int(b)
            fps.append(x)
            groups.append(g)
    fps, groups = np.array(fps, np.uint64), np.array(groups)
    i, j = simhash.within(groups, fps, radius, entries=97)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if groups[a] == groups[b] and bin(int(fps[a]) ^ int(fps[b])).count("1") <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_hot_keys_are_cut_into_chunks(spark):
    fps = [(k << 4) | (1 << 60) for k in range(64)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = {(r["u"], r["v"]) for r in simhash.links(df, 2, chunk=4).collect()}
    assert common.components(spark.createDataFrame(list(edges), "u long, v long")).select("root").distinct().count() == 1


# --- op4


def test_gradients_match_differences():
    net = toxicity.Network(1)
    r = np.random.default_rng(0)
    x = r.normal(size=(9, toxicity.WIDTH)).astype(np.float32)
    ids, mask = toxicity.layout(np.array([0, 4]), np.array([6, 5]), np.arange(9), 9)
    y = np.array([1.0, 0.0], np.float32)
    g, dx, _ = net.gradients(x, ids, mask, y)
    for name in ("Uf", "Vb", "Wf", "a", "o", "cb"):
        p = net.p[name]
        at = tuple(r.integers(0, s) for s in p.shape)
        old = p[at]
        loss = []
        for d in (1e-2, -1e-2):
            p[at] = old + d
            loss.append(net.gradients(x, ids, mask, y)[2])
        p[at] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - g[name][at]) < 2e-3, name


def test_windows_cover_every_word():
    rows = np.repeat([0, 2, 3], [5, 100, 25])
    start, size, row = toxicity.windows(rows)
    seen = set()
    for s, n, r in zip(start, size, row, strict=True):
        assert (rows[s : s + n] == r).all()
        seen |= set(range(s, s + n))
    assert seen == set(range(len(rows)))


def test_held_out_accuracy_and_edges(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").where("length(text) < 3000"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, " \n")], "doc_id long, text string"))
    s = toxicity.scores(docs, labels).join(labels, "doc_id", "left").withColumn("held", toxicity.held_out()).toPandas()
    assert (s[s.doc_id >= 10**9].tox_score < 0.5).all() and s.tox_score.between(0, 1).all()
    h = s[s.held & s.toxic.notna()]
    hit = h.tox_score >= 0.5
    assert (hit & (h.toxic == 1)).sum() >= 0.7 * (h.toxic == 1).sum()
    assert (hit & (h.toxic == 0)).sum() <= 0.02 * (h.toxic == 0).sum()
