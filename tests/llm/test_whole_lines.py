"""Lines under ten characters go as exact repeats."""

import corpus_pipeline
from callatlas.llm import lines


def test_short_lines_are_exact_repeats(spark):
    rows = [(1, "Les.\nA long line of words\n \nLes."), (2, "Les.\nLet.\n\nA long line of wordz\n "), (3, "Let.\nonly here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: "Les.\nA long line of words\n ", 2: "Let.\n\n ", 3: "only here"}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == want
    docs.write.mode("overwrite").parquet(f"{(folder := corpus_pipeline.new_folder(spark, 'short'))}/documents.parquet")
    assert {r["doc_id"]: r["lines_removed"] for r in lines.op9_line_dedup(spark, folder).collect()} == {1: 1, 2: 2, 3: 1}
