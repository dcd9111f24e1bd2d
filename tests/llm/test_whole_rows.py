"""Documents under a null or repeated doc_id are decided row by row."""

from collections import Counter

import corpus_pipeline
from callatlas.llm import simhash, toxicity


def test_near_copies_only_go_under_shared_ids(spark):
    texts = [(None, "one two three four"), (None, "red green blue black"), (None, "red green blue black"), (7, "up down left right"), (7, "north south east west"), (3, "up down left right")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = Counter([(None, "one two three four"), (None, "red green blue black"), (3, "up down left right"), (7, "north south east west")])
    assert Counter(map(tuple, simhash.keep_one(docs).collect())) == want
    assert Counter(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect())) == want


def test_only_toxic_rows_go_under_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "score_texts", lambda net, text: toxicity.np.array([9.0 if "vile" in (t or "") else -9.0 for t in text.to_pylist()]))
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: None)
    rows = [(None, "vile"), (None, "kind"), (None, None), (4, "vile words"), (4, "kind words"), (5, "kind"), (5, "kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int")
    assert Counter(map(tuple, toxicity.without_toxic(docs, labels).collect())) == Counter(r for r in rows if "vile" not in (r[1] or ""))
