"""op6 over long runs of white space."""

import random

import pytest
from pyspark.sql import Row

from callatlas.llm import counts


@pytest.fixture(scope="module")
def coder():
    return counts.encoder(f"{counts.TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_cuts_give_the_ids_of_the_whole(coder):
    r = random.Random(6)
    for _ in range(300):
        t = "".join(r.choice(("a", "b c", ".", "7", r.choice((" ", "\n", "\t", " \n", "　", "\r\n", "\x1f")) * r.randrange(990, 1200), " " * r.randrange(1100))) for _ in range(r.randrange(1, 6)))
        assert counts.count(coder, t) == len(coder.encode_ordinary(t))
    assert counts.count(coder, None) == counts.count(coder, "") == 0


@pytest.mark.parametrize("size", [1_000_000, 10_000_000])
def test_long_white_space_is_counted(spark, coder, size):
    unit = {" ": coder._encode_single_piece(" " * 4000), "\n": coder._encode_single_piece("\n" * 4000)}
    texts = [" " * size, "\n" * size, "a" + " " * size + "b", " \t\n" * (size // 3)]
    got = counts.lengths(spark.createDataFrame([Row(doc_id=k, source=str(k), text=t) for k, t in enumerate(texts)])).collect()
    n = {int(r["source"]): r["n_tokens"] for r in got}
    assert n[0] == size * len(unit[" "]) // 4000 and n[1] == size * len(unit["\n"]) // 4000 and n[2] == n[0] - 1 + 2 and n[3] > 1000
