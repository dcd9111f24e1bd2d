"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, pieces, split_words, table
from .lines import doc_key

#: Words in a window, and from one window to the next. Every window of every text is scored.
WINDOW, STRIDE = 24, 12
#: Labelled documents that the network is trained on, at most, a third of them toxic where there are enough; each is read whole.
SAMPLE = 4500
HIDDEN, WIDTH, BUCKETS = 8, 12, 1 << 15
#: Bytes of text that are scored at a time.
PIECE = 2_000_000
#: Logits are kept between -MOST and MOST, and cut between the classes at a STEPS-th.
MOST, STEPS = 30.0, 16


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): for each word, hash buckets of its inputs: the whole word, and its leading character runs of 2
    to 5 bytes and all runs of 3 and 4, with marks at both ends. ASCII letters are lower-cased, outer punctuation is cut."""
    w = pc.ascii_trim(pc.ascii_lower(words), ".,;:!?()[]{}\"'#*$%&|<>-_")
    w = pc.binary_join_element_wise("\x02", w, "\x03", "")
    raw = np.frombuffer(pc.binary_join(pa.array([w.cast(pa.binary()).to_pylist()], pa.list_(pa.binary())), b"")[0].as_py(), np.uint8).astype(np.uint64)
    size = pc.binary_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    left = np.repeat(start + size, size) - np.arange(len(raw))  # bytes from here to the word's end
    first = np.arange(len(raw)) == np.repeat(start, size)
    mix = lambda h, salt: ((h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    rows, buckets = [], []
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, 8):
        h = h * np.uint64(1099511628211) + np.concatenate((raw, np.zeros(8, np.uint64)))[n - 1 : n - 1 + len(raw)] + np.uint64(1)
        ok = left >= n
        if n in (4, 5):
            rows.append(of[ok])
            buckets.append(mix(h[ok], n))
        if n >= 3:
            ok = ok & first
            rows.append(of[ok])
            buckets.append(mix(h[ok], 16 + n))
    whole = np.zeros(len(size), np.uint64)
    if len(raw):
        power = np.cumprod(np.full(len(raw), 0xD6E8FEB86659FD93, np.uint64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((raw + np.uint64(7)) * power)))
        inverse = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        back = np.cumprod(np.full(len(raw), inverse, np.uint64))
        whole = (sums[start + size] - sums[start]) * back[start]
    rows.append(np.arange(len(size)))
    buckets.append(mix(whole, 99))
    r, b = np.concatenate(rows), np.concatenate(buckets).astype(np.int64) % BUCKETS
    order = np.argsort(r, kind="stable")
    return b[order], np.searchsorted(r[order], np.arange(len(size) + 1))


def all_grams(words: pa.Array, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """grams() of many words, step at a time, as 32-bit numbers."""
    buckets, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for k in range(0, len(words), step):
        b, at = grams(words.slice(k, step))
        buckets.append(b.astype(np.int32))
        sizes.append(np.diff(at))
    return np.concatenate(buckets), np.cumsum(np.concatenate(sizes))


def means(table_: np.ndarray, b: np.ndarray, at: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Mean of the input vectors of each word, step words at a time."""
    out = np.zeros((len(at) - 1, table_.shape[1]), np.float32)
    for k in range(0, len(out), step):
        z = min(k + step, len(out))
        out[k:z] = np.add.reduceat(table_[b[at[k] : at[z]]], at[k:z] - at[k], axis=0) / np.diff(at[k : z + 1])[:, None]
    return out


def embed(table_: np.ndarray, words: pa.Array) -> np.ndarray:
    return means(table_, *all_grams(words))


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of the windows of words that are laid out row after row."""
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [len(rows)])))
    n = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1) if len(rows) else size
    of = np.repeat(np.arange(len(first)), n)
    start = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return first[of] + start, np.minimum(WINDOW, size[of] - start), rows[first[of]]


sigmoid = lambda x: 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Gates z, r and candidate c of two directions; attention over the states of a window; one output."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        h = HIDDEN
        self.p = {"E": (rng.normal(size=(BUCKETS, WIDTH)) * 0.1).astype(np.float32), "a": scale(2 * h), "o": scale(2 * h), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": scale(WIDTH, 3 * h), f"U{d}": scale(h, 2 * h), f"V{d}": scale(h, h), f"c{d}": np.zeros(3 * h, np.float32)}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Inputs of the gates for each word, with a last row for padding, which leaves a state as it is."""
        out = {d: np.zeros((len(x) + 1, 3 * HIDDEN), np.float32) for d in "fb"}
        for d, y in out.items():
            np.matmul(x, self.p[f"W{d}"], out=y[:-1])
            y[:-1] += self.p[f"c{d}"]
            y[-1, :HIDDEN] = 40.0
        return out

    def run(self, inputs: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows ids (n, WINDOW) into the projected words; states and gates too if keep."""
        h, (n, t) = HIDDEN, ids.shape
        states = np.zeros((t, n, 2 * h), np.float32)
        held: dict = {}
        for k, d in enumerate("fb"):
            u, v, s = self.p[f"U{d}"], self.p[f"V{d}"], np.zeros((n, h), np.float32)
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                x = inputs[d][ids[:, i]]
                g = np.tanh(0.5 * (x[:, : 2 * h] + s @ u))
                g *= 0.5
                g += 0.5
                z, r = g[:, :h], g[:, h:]
                c = np.tanh(x[:, 2 * h :] + (r * s) @ v)
                if keep:
                    held[d, i] = (s, z, r, c)
                s = c + z * (s - c)
                states[i, :, k * h : (k + 1) * h] = s
        e = np.where(mask.T, states @ self.p["a"], -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        out = pooled @ self.p["o"] + self.p["b"][0]
        return (out, states, w, pooled, held) if keep else out

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean log loss by parameter, and by word input."""
        h, (n, t), p = HIDDEN, ids.shape, self.p
        inputs = self.project(x)
        out, states, w, pooled, held = self.run(inputs, ids, mask, keep=True)
        prob = sigmoid(out)
        loss = float(-np.mean(np.log(np.where(y > 0.5, prob, 1 - prob) + 1e-9)))
        dout = ((prob - y) / n).astype(np.float32)
        g = {"o": pooled.T @ dout, "b": dout.sum(keepdims=True)}
        dpool = dout[:, None] * p["o"]
        dw = np.einsum("nh,tnh->tn", dpool, states)
        de = w * (dw - (w * dw).sum(axis=0))
        dstates = w[:, :, None] * dpool + de[:, :, None] * p["a"]
        g["a"] = np.einsum("tn,tnh->h", de, states)
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, v = p[f"U{d}"], p[f"V{d}"]
            gu, gv, parts, ds = np.zeros_like(u), np.zeros_like(v), [], np.zeros((n, h), np.float32)
            turns = range(t - 1, -1, -1) if d == "f" else range(t)
            for i in turns:
                s, z, r, c = held[d, i]
                ds = ds + dstates[i, :, k * h : (k + 1) * h]
                dc = ds * (1 - z) * (1 - c * c)
                dz = ds * (s - c) * z * (1 - z)
                drs = dc @ v.T
                dr = drs * s * r * (1 - r)
                gates = np.concatenate((dz, dr), axis=1)
                gu += s.T @ gates
                gv += (r * s).T @ dc
                ds = ds * z + drs * r + gates @ u.T
                parts.append(np.concatenate((gates, dc), axis=1))
            din = summed(np.concatenate([ids[:, i] for i in turns]), np.concatenate(parts), len(x) + 1)[:-1]
            g |= {f"U{d}": gu, f"V{d}": gv, f"W{d}": x.T @ din, f"c{d}": din.sum(axis=0)}
            dx += din @ p[f"W{d}"].T
        return g, dx, loss


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by number."""
    return np.stack([np.bincount(at, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1).astype(np.float32)


def layout(start: np.ndarray, size: np.ndarray, ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    at = start[:, None] + np.arange(WINDOW)
    mask = np.arange(WINDOW) < size[:, None]
    return np.where(mask, ids[np.minimum(at, len(ids) - 1)], pad), mask


def fit(texts: list[str] | pa.Array, toxic: np.ndarray, rounds: int = 8, batch: int = 256, rate: float = 0.02, seed: int = 0) -> Network:
    """Train on the windows of labelled texts. A toxic text vouches only for its worst window: after two rounds in which four
    of its windows count, drawn at random, the one that scores highest does. Of clean texts all windows are clean."""
    net, rng = Network(seed), np.random.default_rng(seed)
    words, rows = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    if not len(words):
        return net
    enc = words.dictionary_encode()
    ids, vocabulary = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary
    start, size, row = windows(rows)
    del words, rows, enc  # a worker's memory is short, and only numbers are needed from here on
    b, at = all_grams(vocabulary)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    mean = lambda: means(net.p["E"], b, at)
    for turn in range(rounds):
        scores = window_scores(net, mean(), ids, start, size) if turn >= 2 else rng.random(len(start))
        bad = np.flatnonzero(toxic[row] == 1)
        bad = bad[np.lexsort((-scores[bad], row[bad]))]
        if len(bad):
            new = np.concatenate(([True], row[bad][1:] != row[bad][:-1]))
            nth = np.arange(len(bad)) - np.maximum.accumulate(np.where(new, np.arange(len(bad)), 0))
            bad = bad[nth < (1 if turn >= 2 else 4)]
        clean = np.flatnonzero(toxic[row] == 0)
        hard = clean[np.argsort(-scores[clean])[: len(bad) + batch]]
        clean = np.unique(np.concatenate((hard, rng.choice(clean, min(len(clean), 2 * len(bad) + batch), replace=False)))) if len(clean) else clean
        order = rng.permutation(np.concatenate((bad, clean)))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            used, local = np.unique(ids[np.unique(np.minimum(start[part][:, None] + np.arange(WINDOW), len(ids) - 1))], return_inverse=False), None
            place = np.zeros(len(vocabulary), np.int64)
            place[used] = np.arange(len(used))
            spans = [b[at[u] : at[u + 1]] for u in used]
            count = np.array([len(s) for s in spans])
            flat, edge = np.concatenate(spans), np.cumsum(count) - count
            x = (np.add.reduceat(net.p["E"][flat], edge, axis=0) / count[:, None]).astype(np.float32)
            local, mask = layout(start[part], size[part], place[ids], len(used))
            g, dx, _ = net.gradients(x, local, mask, toxic[row[part]].astype(np.float32))
            g["E"] = summed(flat, np.repeat(dx / count[:, None], count, axis=0), BUCKETS)
            step += 1
            for name, value in g.items():
                m, v = moments[name]
                m += 0.1 * (value - m)
                v += 0.001 * (value * value - v)
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def window_scores(net: Network, x: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray, batch: int = 4096) -> np.ndarray:
    inputs, out = net.project(x.astype(np.float32, copy=False)), np.zeros(len(start), np.float32)
    for k in range(0, len(start), batch):
        local, mask = layout(start[k : k + batch], size[k : k + batch], ids, len(x))
        out[k : k + batch] = net.run(inputs, local, mask)
    return out


def score_texts(net: Network, text: pa.Array) -> np.ndarray:
    """Per text the logit of its worst window, from -MOST to MOST; a text without words: -MOST."""
    words, rows = split_words(text)
    top = np.full(len(text), -MOST)
    if len(words):
        enc = words.dictionary_encode()
        start, size, row = windows(rows)
        s = window_scores(net, embed(net.p["E"], enc.dictionary), enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), start, size)
        np.maximum.at(top, row, s)
    return np.minimum(top, MOST)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sample_ids(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(sample_id, label) of at most sample labelled documents that are not held out, a third of them toxic at most.

    Chosen by hash of doc_id: a threshold from the number of each label's rows lets about twice as many through as are
    taken, and only these are sorted.
    """
    marks = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("label"))
    rows = docs.where(~held_out()).select("doc_id").join(marks, F.col("doc_id") == F.col("label_id")).select("doc_id", "label", F.xxhash64("doc_id").alias("h"))
    rows = cut(rows.distinct())
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row a label

    def first(label: int, most: int) -> DataFrame:
        below = min(1.0, (2 * most + 200) / max(1, n.get(label, 0)))
        own = rows.where((F.col("label") == label) & (F.col("h") <= int(-(2**63) + below * (2**64 - 1025))))
        return own.orderBy("h", "doc_id").select(F.col("doc_id").alias("sample_id"), "label").limit(most)

    return first(1, sample // 3).union(first(0, sample - sample // 3)).distinct()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network trained on the sample's whole texts in one task, which sends back the parameters. Of several texts under a
    doc_id the first in order is taken."""
    ids = sample_ids(docs, labels, sample)
    got = docs.where(F.col("text").isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            held.clear()
            net = fit(t.column("text").combine_chunks(), t.column("label").to_numpy().astype(np.int64))
            del t
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array(list(net.p)), pa.array([v.tobytes() for v in net.p.values()], pa.binary())], ["name", "value"])

    net = Network()
    for r in got.repartition(1).sortWithinPartitions("doc_id", "label").select("text", "label").mapInArrow(learn, "name string, value binary").collect():  # the parameters
        net.p[r["name"]] = np.frombuffer(r["value"], np.float32).reshape(net.p[r["name"]].shape).copy()
    return net


def logits(docs: DataFrame, net: Network, keyed: bool = False) -> DataFrame:
    """(doc_id, tox_logit) of each whole text; keyed: with doc_key, the digest of a row's doc_id and text."""
    more = [F.unhex(doc_key()).alias("doc_key")] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(pieces(batches, "text", PIECE)):
            key = [b.column("doc_key")] if keyed else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(score_texts(net, b.column("text"))), *key], ["doc_id", "tox_logit", *["doc_key"] * keyed])

    return docs.select("doc_id", "text", *more).mapInArrow(run, "doc_id long, tox_logit double" + ", doc_key binary" * keyed)


def boundary(marked: DataFrame) -> float:
    """The logit that parts the classes best, a clean document lost counting as three toxic ones missed: from a histogram of
    all labelled rows that are not held out. Among equal cuts the middle one; without labels 0."""
    bins = marked.where(~held_out()).groupBy(F.floor(F.col("tox_logit") * STEPS).alias("bin")).agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("good"))
    size = int(2 * MOST * STEPS) + 2
    good, bad = np.zeros(size), np.zeros(size)
    for r in bins.collect():  # size rows at most
        k = r["bin"] + size // 2
        good[k], bad[k] = r["good"], r["bad"]
    if not good.sum() or not bad.sum():
        return 0.0
    errors = 3 * (good.sum() - np.concatenate(([0], np.cumsum(good)[:-1]))) + np.concatenate(([0], np.cumsum(bad)[:-1]))
    best = np.flatnonzero(errors == errors.min())
    run = best[: np.flatnonzero(np.diff(np.concatenate((best, [size * 2]))) > 1)[0] + 1]
    return (float(run[0] + run[-1]) / 2 - size // 2) / STEPS


def scores(docs: DataFrame, labels: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, tox_score), keyed with doc_key before tox_score: from 0 to 1 of each whole text, 0.5 and more for toxic.

    Null, empty and blank texts score near 0. Equal texts score alike. Only the text is an input of a score. Labels of held
    out documents, and null labels, teach nothing; without labels of both kinds scores mean nothing. No rows: none. Other
    columns, whatever their names, take no part.
    """
    net = train(docs, labels)
    out = cut(logits(docs, net, keyed))
    marks = labels.where("toxic is not null").select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("label"))
    at = boundary(out.join(marks, F.col("doc_id") == F.col("label_id")))
    return out.select("doc_id", *["doc_key"] * keyed, (1 / (1 + F.exp(F.lit(at) - F.col("tox_logit")))).alias("tox_score"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more. Rows are told apart by doc_id and text: of several under one doc_id, or
    under none, only the toxic ones go. Repeated clean rows stay repeated; other columns stay, whatever their names."""
    bad = scores(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), keyed=True).where("tox_score >= 0.5").select("doc_key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(doc_key()).alias("doc_key"))
    return rows.join(bad, "doc_key", "left_anti").select("row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and prediction; null and empty texts score near 0, no rows: none."""
    out = scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), F.when(F.col("tox_score") >= 0.5, 1).otherwise(0).alias("predicted"))
