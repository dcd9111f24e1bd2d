"""Restoring only in the spoken language, and what is noted about a written article."""

from callatlas.operators import articles as A

STEP = "call_id long, number int, section string, title string, instruction string, details string, actor string, time_s double, end_s double"


def test_steps_come_back_in_the_spoken_language_only(spark):
    step = lambda call, k, t: (call, k, f"s{k}", "t", f"i{k}", None, "support", t, t + 1.0)
    wrote = spark.createDataFrame([step(1, 1, 5.0), step(1, 2, 30.0), step(2, 1, 5.0), step(3, 1, 5.0), step(5, 1, 5.0)], STEP)
    missing = spark.createDataFrame([step(1, 4, 10.0), step(1, 5, 40.0), step(2, 4, 10.0), step(5, 9, 60.0)], STEP)
    known = spark.createDataFrame([(1, "de", "de"), (2, "de", "en"), (3, None, "en"), (4, "de", "de"), (5, None, None)], "call_id long, spoken string, article string")
    said = spark.createDataFrame([(c, k + 1, t) for c in (1, 2, 3, 4, 5) for k, t in enumerate((3.0, 100.0, 90.0 if c != 3 else 12.0))], "call_id long, sent_no int, end_s double")
    steps, notes = A.finished(wrote, missing, known, said)
    got = [(x["call_id"], x["number"], x["instruction"], x["section"], x["was_restored"]) for x in steps.orderBy("call_id", "number").collect()]
    assert got == [(1, 1, "i1", "s1", False), (1, 2, "i4", "s1", True), (1, 3, "i2", "s2", False), (1, 4, "i5", "s2", True), (2, 1, "i1", "s1", False), (3, 1, "i1", "s1", False), (5, 1, "i1", "s1", False), (5, 2, "i9", "s1", True)]
    want = {(1, "written", 2, None, None), (2, "written", 1, None, None), (3, "written", 1, None, None), (4, "written", 0, None, None), (5, "written", 1, None, None), (1, "restored", 2, None, None), (2, "not_restored", 1, None, None), (5, "restored", 1, None, None), (1, "short", None, 41.0, 90.0), (2, "short", None, 6.0, 90.0)}
    assert {tuple(x) for x in notes.collect()} == want  # call 3 spoke to 12 s and covers 6 s: half
    none = A.finished(wrote.limit(0), missing.limit(0), known.limit(0), said.limit(0))
    assert none[0].count() == none[1].count() == 0
