"""Pages go through shuffles once on their way to archives, and repeated ids still give one response a payload."""

import functools
import random
from collections import defaultdict

import pytest

from callatlas.llm import common, warc


def shuffled(spark):
    """Bytes written to shuffles by all stages so far."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("times", [1, 2])
def test_texts_are_shuffled_once(spark, times):
    r = random.Random(1)
    pages = [(i, f"u{i}", f"{r.getrandbits(80000):x}") for i in range(300)] + [(i, "short", "x" * i) for i in range(300, 310)]
    pages *= times
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    warc.with_revisits(df).write.format("noop").mode("overwrite").save()
    assert 0 < shuffled(spark) - before < 1.4 * sum(len(h) for *_, h in pages)


@pytest.mark.parametrize("buckets", [1, 3, 1 << 18])
def test_one_response_a_payload_under_repeated_ids(spark, monkeypatch, buckets):
    monkeypatch.setattr(warc, "reduced", functools.partial(common.reduced, buckets=buckets))
    r = random.Random(2)
    big = [f"<p>{k}" + "é" * 600 for k in range(4)]
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, "a", "b"]), r.choice([*big, "short", "", None])) for _ in range(300)]
    rows += [(20 + k, "one", f"<p>{k} once" + "w " * 600) for k in range(20)] + [(40, None, "x" * 999), (41, "u", "y" * 1000)]
    rows += [(7, u, big[0]) for u in ("z", "y", "y")] + [(8, "only", "lonely " * 200)] * 2 + [(None, "n", "nobody " * 200)] * 3
    got = defaultdict(list)
    for x in warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[x["page_id"], x["url"], x["html"]].append(x["refers_to"])
    want = defaultdict(list)
    for i, u, h in rows:
        same = [(j, v) for j, v, g in rows if g == h and j is not None]
        top = max((j for j, _ in same), default=None)
        if len((h or "").encode()) < 1000 or top is None:
            want[i, u, h].append(None)
            continue
        first = min((v is not None, v or "") for j, v in same if j == top)
        response = i == top and (u is not None, u or "") == first and not want[i, u, h]
        want[i, u, h].append(None if response else top)
    key = lambda m: {k: sorted(v, key=str) for k, v in m.items()}
    assert key(got) == key(want)
