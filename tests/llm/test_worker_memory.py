import tracemalloc

import numpy as np

from callatlas.llm import pieces, similar, toxicity


def peak_mb(f, *args):
    tracemalloc.start()
    out = f(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak / 1e6


def test_a_large_family_is_joined_in_little_memory():
    base, rng = np.arange(200, dtype=np.uint64), np.random.default_rng(0)
    sets = [np.unique(np.concatenate((rng.permutation(base)[:195], [np.uint64(1000 + k)])).astype(np.uint64)) for k in range(2200)]
    (i, j), peak = peak_mb(similar.near, sets)
    assert len(i) == len(sets) - 1 and peak < 100


def test_words_are_projected_in_place():
    net, x = toxicity.Network(), np.random.default_rng(0).normal(size=(200_000, toxicity.WIDTH)).astype(np.float32)
    got, peak = peak_mb(net.project, x)
    assert peak < 1.2 * sum(v.nbytes for v in got.values()) / 1e6
    for d, v in got.items():
        assert np.array_equal(v[:-1], x @ net.p[f"W{d}"] + net.p[f"c{d}"])
        assert (v[-1, : toxicity.HIDDEN] == 40).all() and not v[-1, toxicity.HIDDEN :].any()


def test_stretches_that_come_again_stay_kept(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    codec, asked = pieces.Codec(), []
    plain = codec.viterbi
    monkeypatch.setattr(codec, "viterbi", lambda chars: asked.append(chars) or plain(chars))
    for k in range(1000):
        codec.stretch(f"{pieces.SPACE}w{k}")
        assert codec.stretch(f"{pieces.SPACE}often") == plain(f"{pieces.SPACE}often")
        assert len(codec.kept) + len(codec.older) <= 100
    assert asked.count(f"{pieces.SPACE}often") == 1
