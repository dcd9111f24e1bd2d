"""Letters are counted only where lines meet under a key."""

import hashlib

from callatlas.llm import lines


def test_letters_are_counted_of_lines_that_meet(spark, monkeypatch):
    seen = []
    count = lines.with_letters
    monkeypatch.setattr(lines, "with_letters", lambda df: seen.append(df) or count(df))
    rows = [(k, "\n".join(hashlib.sha256(f"{k} {j}".encode()).hexdigest() for j in range(10))) for k in range(50)]
    rows += [(100, "the quick brown fox jumps over it\nsomething else altogether here"), (101, "the quick brown fox jumped over it\nthe quick brown fox jumps over it")]
    got = {x["doc_id"]: x["lines_removed"] for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == 0 and got[101] == 2
    assert 0 < sum(df.count() for df in seen) < 10
