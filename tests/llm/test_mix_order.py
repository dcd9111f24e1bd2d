"""The mix under repeated doc_ids of equal sizes."""

from callatlas.llm import mixing


def test_the_order_of_rows_changes_nothing(spark):
    rows = [(7, f"w{k} x y", "a") for k in range(60)] + [(k, f"v{k} " * 3, "b") for k in range(30)]
    taken = []
    for given in (rows, rows[::-1]):
        d = spark.createDataFrame(given, "doc_id long, text string, source string")
        taken.append(sorted((r["doc_id"], r["text"], r["mix_copies"]) for r in mixing.mix(d).collect()))
    assert taken[0] == taken[1] and len({c for _, _, c in taken[0]}) > 1
