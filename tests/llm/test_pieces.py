import random
import time

import pyarrow as pa
import pytest
import sentencepiece

from callatlas.llm import pieces


def library():
    """The model's own library with the same pieces, as a unigram model."""
    raw = open(pieces.MODEL, "rb").read()

    def varint(b, i):
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if not b[i - 1] & 128:
                return n, i

    def put(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def fields(b):
        i = 0
        while i < len(b):
            at = i
            tag, i = varint(b, i)
            if tag & 7 == 2:
                n, i = varint(b, i)
                i += n
                yield tag >> 3, b[at:i], b[i - n : i]
            else:
                i = varint(b, i)[1] if tag & 7 == 0 else i + {1: 8, 5: 4}[tag & 7]
                yield tag >> 3, b[at:i], None

    out = b""
    for number, whole, body in fields(raw):
        if number == 2:  # trainer_spec: model_type (3) becomes UNIGRAM
            body = b"".join(w for k, w, _ in fields(body) if k != 3) + put(3 << 3) + put(1)
            whole = put(2 << 3 | 2) + put(len(body)) + body
        out += whole
    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(out)
    return sp


TEXTS = ["", " ", "Hello world", "  two  spaces ", "a\nb\tc", "ünïcödé 漢字 \U0001f600!", "x" * 3000, "the " * 500, "1234567890" * 30, "     " * 40, "and.then,some;code(){}"]


def brute(codec, text):
    """Best path by the plain quadratic recurrence."""
    s = pieces.SPACE + text.replace(" ", pieces.SPACE)
    best = [(0.0, 0, None)] + [None] * len(s)
    for a in range(len(s)):
        for z in range(a + 1, min(len(s), a + codec.longest) + 1):
            i = codec.ids.get(s[a:z])
            if i is not None:
                x = best[a][0] + codec.score[i]
            elif z == a + 1:
                x = best[a][0] + codec.unknown
            else:
                continue
            if best[z] is None or x > best[z][0]:
                best[z] = (x, a, i)
    ids, z = [], len(s)
    while z:
        _, a, i = best[z]
        ids += [i] if i is not None else [codec.byte[x] for x in reversed(s[a:z].encode())]
        z = a
    return ids[::-1]


def random_texts(n=60):
    r = random.Random(1)
    return ["".join(r.choice("abcdehilnorst  \n.,éüß") for _ in range(r.randrange(1, 400))) for _ in range(n)]


def total(codec, ids):
    return sum(codec.score.get(i, 0.0) for i in ids)


def test_encode_matches_brute_force_and_never_scores_below_the_library():
    codec, sp = pieces.Codec(), library()
    texts = TEXTS + random_texts()
    got = codec.encode(pa.array(texts)).to_pylist()
    for t, ids in zip(texts, got, strict=True):
        assert ids == (brute(codec, t) if t else []), t[:50]
        if t:
            assert total(codec, ids) >= total(codec, sp.encode(t)), t[:50]


def test_round_trip_and_nulls():
    codec = pieces.Codec()
    texts = [*TEXTS, *random_texts(), "a\x00b c", None]
    got = codec.encode(pa.array(texts, pa.string())).to_pylist()
    assert [codec.decode(x) for x in got] == texts
    assert codec.decode_all(pa.array(got, pa.list_(pa.int32()))).to_pylist() == texts


def test_long_stretch_commits_with_bounded_window():
    codec = pieces.Codec()
    t = "ab" * 50_000
    assert codec.decode(codec.viterbi(pieces.SPACE + t)) == t


@pytest.mark.parametrize("n", [0, 3])
def test_dataframe(spark, n):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, "y"), (2, "", "z")][: n + 1 if n else 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(docs, keep=("doc_id", "text"))).collect()
    assert len(out) == len(rows)
    assert all(r["decoded"] == r["text"] for r in out)


def test_unspaced_text_takes_linear_time_and_a_bounded_window(monkeypatch):
    codec, widest = pieces.Codec(), [0]
    path = pieces.Codec._path
    monkeypatch.setattr(pieces.Codec, "_path", lambda self, chars, base, end, *a: (widest.__setitem__(0, max(widest[0], end - base)), path(self, chars, base, end, *a))[1])
    r = random.Random(2)
    began = time.time()
    for t in ("a" * 300_000, "".join(r.choice("abcdefgh") for _ in range(100_000)), "\u6f22" * 50_000):
        widest[0] = 0
        assert codec.decode(codec.viterbi(pieces.SPACE + t)) == t
        if t[0] != "a":
            assert widest[0] <= 16 * codec.longest
    assert time.time() - began < 60
