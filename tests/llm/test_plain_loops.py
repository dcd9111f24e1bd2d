"""What SQL can't express, against plain loops: the network's forward pass, path lengths and thresholds of the forests, token
counts by merging, pseudonyms of every kind, stages of the pipeline on what the stage before kept."""

import base64
import datetime
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import regex

import corpus_pipeline
from callatlas.llm import counts, pii, pieces, quality, toxicity

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "doc_id long, text string, source string")


# --- op4


def plain_logit(p, xs):
    """The logit of one window of word vectors, number by number."""
    h = toxicity.HIDDEN
    dot = lambda v, m, k: sum(v[i] * float(m[i][k]) for i in range(len(v)))
    sig = lambda t: 1 / (1 + math.exp(-t))
    states = [[0.0] * (2 * h) for _ in xs]
    for part, d in enumerate("fb"):
        W, U, V, c0 = (p[f"{n}{d}"] for n in "WUVc")
        s = [0.0] * h
        for i in range(len(xs)) if d == "f" else reversed(range(len(xs))):
            z = [sig(dot(xs[i], W, k) + float(c0[k]) + dot(s, U, k)) for k in range(h)]
            r = [sig(dot(xs[i], W, h + k) + float(c0[h + k]) + dot(s, U, h + k)) for k in range(h)]
            gated = [r[k] * s[k] for k in range(h)]
            c = [math.tanh(dot(xs[i], W, 2 * h + k) + float(c0[2 * h + k]) + dot(gated, V, k)) for k in range(h)]
            s = [z[k] * s[k] + (1 - z[k]) * c[k] for k in range(h)]
            states[i][part * h : (part + 1) * h] = s
    e = [sum(float(p["a"][k]) * v[k] for k in range(2 * h)) for v in states]
    w = [math.exp(v - max(e)) for v in e]
    pooled = [sum(w[i] * states[i][k] for i in range(len(xs))) / sum(w) for k in range(2 * h)]
    return sum(float(p["o"][k]) * pooled[k] for k in range(2 * h)) + float(p["b"][0])


def test_scores_are_those_of_the_worst_of_all_overlapping_windows():
    r = random.Random(5)
    vocabulary = ["good", "BAD,", "bäd", "(x)", "", "zzz", "1234"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 23, 24, 25, 36, 37, 61, 100)] + ["", None, " \n", "w" * 5000]
    net = toxicity.Network(3)
    net.p["E"] = net.p["E"] * 10
    got = toxicity.score_texts(net, pa.array(texts, pa.string()))
    for text, logit in zip(texts, got, strict=True):
        words = WORDS.findall(text or "")
        xs = [[float(v) for v in x] for x in toxicity.embed(net.p["E"], pa.array(words, pa.string()))] if words else []
        starts = [k for k in range(0, len(xs), toxicity.STRIDE) if k == 0 or k < len(xs) - toxicity.WINDOW + toxicity.STRIDE]
        want = max((plain_logit(net.p, xs[k : k + toxicity.WINDOW]) for k in starts), default=-toxicity.MOST)
        assert logit == pytest.approx(want, abs=1e-4), text


def test_inputs_of_a_word_are_itself_and_its_runs_of_characters():
    words = ["a", "abc", "häuser"]
    b, at = toxicity.grams(pa.array(words))
    for k, w in enumerate(words):
        n = len(f"\x02{w}\x03".encode())
        runs = sum(max(0, n - size + 1) for size in (4, 5)) + sum(size <= n for size in range(3, 8)) + 1
        assert at[k + 1] - at[k] == runs
    own = lambda w: sorted(toxicity.grams(pa.array([w]))[0].tolist())
    assert own("Abc!") == own("abc") and own("abc") != own("abd") and own("abc") == sorted(b[at[1] : at[2]].tolist())


# --- op5


def expected(n):
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def test_paths_and_anomalies_are_those_of_walking_each_tree():
    x = np.random.default_rng(1).normal(size=(120, 4))
    x[:7] = x[0]  # equal rows can't be split
    forest = quality.grow(x, trees=9, subsample=500)  # each tree takes all rows
    total = [0.0] * len(x)
    for f, v, left, right, path in forest["trees"]:
        leaves = {}
        for k, row in enumerate(x):
            at, depth = 0, 0
            while f[at] >= 0:
                at, depth = int(left[at] if row[int(f[at])] < v[at] else right[at]), depth + 1
            leaves.setdefault((at, depth), []).append(k)
        for (at, depth), rows in leaves.items():
            assert depth <= math.ceil(math.log2(len(x))) and path[at] == pytest.approx(depth + expected(len(rows)))
            for k in rows:
                total[k] += depth + expected(len(rows))
    want = [2 ** (-t / 9 / expected(len(x))) for t in total]
    assert quality.score(forest, x) == pytest.approx(want)


def test_thresholds_lose_no_more_good_rows_than_allowed(spark):
    r = random.Random(2)
    rows = [(r.choice([0, 1, 1, 1]), [r.random() for _ in quality.VIEWS]) for _ in range(700)]
    scored = spark.createDataFrame(rows, "quality int, anomalies array<double>")
    for lost in (0.0, 0.001, 0.05):
        for k, cut in enumerate(quality.calibrate(scored, lost)):
            good = [int(a[k] * quality.BINS) for q, a in rows if q == 1]
            allowed = [b for b in range(quality.BINS + 1) if sum(g >= b for g in good) <= lost * len(good)]
            assert cut == min(allowed) / quality.BINS
    assert quality.calibrate(scored.where("quality = 0")) == [2.0] * len(quality.VIEWS)


def test_verdicts_follow_from_anomalies_and_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, labels).collect()
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    cuts = []
    for k in range(len(quality.VIEWS)):
        own = [int(r["anomalies"][k] * quality.BINS) for r in got if not r["base_failed"] and r["doc_id"] in good]
        cuts.append(min(b for b in range(quality.BINS + 1) if sum(g >= b for g in own) <= 0.001 * len(own)) / quality.BINS)
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and all(a < c for a, c in zip(r["anomalies"], cuts, strict=True)))


# --- op6


def merged(piece, ranks):
    """Tokens of one pretoken: the pair of lowest rank is joined, again and again."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], math.inf))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return len(parts)


def test_lengths_are_those_of_merging_pair_by_pair(spark):
    with open(f"{counts.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts += [None, "", " ", "it's 漢字 \U0001f600  \n\tend ", "x" * 300, "a" + " " * 1500 + "b", "\n" * 1200, " " * 1001 + "é"]
    long = {}
    want = []
    for t in texts:
        n = 0
        for piece in pattern.findall(t or ""):
            if piece not in long:
                long[piece] = merged(piece.encode(), ranks)
            n += long[piece]
        want.append(n)
    got = [r["n_tokens"] for r in counts.lengths(docs_of(spark, texts)).collect()]
    assert sorted(got) == sorted(want)


# --- op7


def feistel(left, right, a, b, tweak, key):
    for i in range(pii.ROUNDS):
        h = int(hashlib.sha256(f"{key}|{tweak}|{i}|{right if i % 2 == 0 else left}".encode()).hexdigest()[:15], 16)
        left, right = ((left + h) % a, right) if i % 2 == 0 else (left, (right + h) % b)
    return left, right


def digits_moved(d, tweak, key):
    n = len(d) // 2
    x, y = feistel(int(d[:n] or 0), int(d[n:] or 0), 10**n, 10 ** (len(d) - n), f"{tweak}{len(d)}", key)
    return (str(x).zfill(n) if n else "") + (str(y).zfill(len(d) - n) if d else "")


def refill(form, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def plain(kind, m, key):
    d = re.sub(r"\D", "", m)
    if kind == "phone":
        c = len(re.match(r"\+(\d{1,3})", m)[1]) if m.startswith("+") else 0
        return refill(m, d[:c] + digits_moved(d[c:], "phone", key))
    if kind == "ssn":
        area = int(m[:3])
        x, y = feistel((area - 1 - (area > 666)) * 99 + int(m[4:6]) - 1, int(m[-4:]) - 1, 88902, 9999, "ssn", key)
        g = x // 99 + 1
        return f"{g + (g > 665):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if kind == "iban":
        s = m.replace(" ", "")
        body = refill(s[4:], digits_moved(re.sub(r"\D", "", s[4:]), "iban", key))
        new = iter(f"{s[:2]}{98 - mod97(body + s[:2] + '00'):02d}{body}")
        return "".join(c if c == " " else next(new) for c in m)
    if kind == "date":
        sep = m[2]
        day = (datetime.datetime.strptime(m, f"%d{sep}%m{sep}%Y").date() - datetime.date(1900, 1, 1)).days
        x, y = feistel(day // 319, day % 319, 229, 319, "date", key)
        return (datetime.date(1900, 1, 1) + datetime.timedelta(x * 319 + y)).strftime(f"%d{sep}%m{sep}%Y")
    out = ""
    name, rest = m.lower().split("@")[0], m[m.index("@") :]
    for q, w in enumerate(re.findall(r"[a-z]{1,12}|[0-9]{1,12}|[^a-z0-9]+", name)):
        if w[0].isdigit():
            w = digits_moved(w, f"mail{q}", key)
        elif w[0].isalpha():
            n, num = len(w) // 2, lambda t: sum((ord(c) - 97) * 26**k for k, c in enumerate(reversed(t)))
            word = lambda v, k: "".join(chr(97 + v // 26**j % 26) for j in reversed(range(k)))
            x, y = feistel(num(w[:n]), num(w[n:]), 26**n, 26 ** (len(w) - n), f"mail{q}{len(w)}", key)
            w = word(x, n) + word(y, len(w) - n)
        out += w
    return out + rest


def test_pseudonyms_of_every_kind_are_brute_force(spark):
    key = hashlib.sha256(b"k3").hexdigest()
    valid = [
        ("phone", "+1 (974) 555-3436"), ("phone", "(044) 123-4567"), ("phone", "+41 44 123 45 67"), ("phone", "555-123-4567"),
        ("ssn", "219-09-9999"), ("ssn", "001-01-0001"), ("ssn", "665-99-9999"), ("ssn", "899-50-1234"),
        ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
        ("date", "31.12.1999"), ("date", "01/02/1900"), ("date", "29.02.2024"),
        ("email", "und.34@mail7.example.com"), ("email", "A-long_Name.of.thirteenletters99@b.org"), ("email", "x@y.de"),
    ]
    refused = ["000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000", "DE88 3704 0044 0532 0130 00", "30.02.2001", "32/01/2000", "31.12.2100"]
    texts = [f"before {m} after" for _, m in valid] + [f"before {m} after" for m in refused]
    got = pii.pseudonymised(docs_of(spark, texts), "k3").orderBy("doc_id").collect()
    for r, (kind, m) in zip(got, valid):
        new = r["text"][len("before ") : -len(" after")]
        assert (new, [(x["kind"], x["length"]) for x in r["pii_found"]]) == (plain(kind, m, key), [(kind, len(m))]), m
        assert kind != "iban" or mod97(new.replace(" ", "")[4:] + new[:4]) == 1
    assert [r["text"] for r in got[len(valid) :]] == texts[len(valid) :]


# --- pipeline


def test_stages_are_brute_force_on_what_the_stage_before_kept(spark, tmp_path):
    """The near-dedup and the encoder on documents as the stages before them leave them."""
    docs, held = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        held.append(docs.collect())
    sets = []
    for r in (rows := sorted(held[1], key=lambda r: r["doc_id"])):
        w = (r["text"] or "").lower().split()
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert sorted(r["doc_id"] for r in held[2]) == sorted(rows[k]["doc_id"] for k in set(root))
    codec = pieces.Codec()
    text_of = {r["doc_id"]: r["text"] for r in held[2]}
    size = lambda t: len(WORDS.findall(t or ""))
    assert all(r["text"] == text_of[r["doc_id"]] for r in held[3])  # the mix changes no text
    taken = {}
    for r in held[3]:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert max(taken.values()) <= 3 and sum(n * size(text_of[i]) for i, n in taken.items()) > 0
    decoded = sorted((r["doc_id"], tuple(r["ids"]) if r["ids"] is not None else None) for r in held[4])
    ids = {i: codec.encode(pa.array([t], pa.string())).to_pylist()[0] for i, t in text_of.items() if i in taken}
    assert decoded == sorted((r["doc_id"], tuple(ids[r["doc_id"]]) if ids[r["doc_id"]] is not None else None) for r in held[3])
