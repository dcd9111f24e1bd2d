"""The boundary to models: request tables, replaceable services with fallbacks, and answers read as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Service = Callable[[pd.DataFrame], pd.Series]
SERVICES: dict[tuple[str, str], Service] = {}
KINDS = ("speech", "ui_parser", "grounder", "tracker", "describer", "text_generator")


def register(kind: str, name: str, service: Service) -> None:
    """A service of one of six kinds under a name: from a frame of requests to a series of answers."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    SERVICES[kind, name] = service


def asked(service: Service, rows: pd.DataFrame, sticky: bool = False) -> list[tuple | None]:
    """(answer, error) of each row. The service gets all rows at once; rows that it fails are halved until the bad ones are alone,
    so k bad rows of n take 2 k log2(n) + 1 calls at most, and a row may be asked for again. sticky: rows after the first bad
    one are left as None."""
    out: list[tuple | None] = [None] * len(rows)
    todo = [(0, len(rows))] if len(rows) else []
    while todo:
        a, b = todo.pop()
        try:
            got = list(service(rows.iloc[a:b]))
            if len(got) != b - a:
                raise ValueError(f"{len(got)} answers to {b - a} requests")
            out[a:b] = [(x, None) for x in got]
        except Exception as e:  # any failure of a service is what the fallback is for
            if b - a > 1:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                continue
            out[a] = (None, str(e)[:200])
            if sticky:
                break
    return out


def answered(requests: DataFrame, kind: str, primary: str, fallback: str | None = None, sticky: bool = False, most: int = 256) -> DataFrame:
    """Requests with answer, status (ok, fallback, failed), note and model; a service gets most requests at a time.

    A request that the primary service fails goes to the fallback and keeps a note. sticky: after the first failure the
    partition stays with the fallback. Services must bear a request that comes twice.
    """
    first, second = SERVICES[kind, primary], SERVICES[kind, fallback] if fallback else None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lost = False
        for whole in batches:
            for at in range(0, len(whole), most):
                b = whole.iloc[at : at + most]
                got = [None] * len(b) if lost else asked(first, b, sticky and second is not None)
                lost = lost or None in got
                out = [(g[0], "ok", None, primary) if g and g[1] is None else (None, "failed", g and f"{primary} not usable ({g[1]})", primary) for g in got]
                left = [k for k, o in enumerate(out) if o[1] == "failed"]
                if second is not None:
                    lost = lost or (sticky and bool(left))
                    for k, (answer, error) in zip(left, asked(second, b.iloc[left]), strict=True):
                        note = out[k][2]
                        out[k] = (answer, "fallback", note, fallback) if error is None else (None, "failed", f"{note}; {error}" if note else error, fallback)
                yield b.assign(**{n: [o[i] for o in out] for i, n in enumerate(("answer", "status", "note", "model"))})

    return requests.mapInPandas(run, f"{fields}, answer string, status string, note string, model string")


UI_FILE = "elements array<struct<bbox:array<int>,text:string,text_confidence:double,interactive_confidence:double,class:string>>"
UI_ANSWER = "elements array<struct<text:string,type:string,interactive:boolean,box:array<double>>>"
POINTS = "points array<struct<object_id:string,time_s:double,x:int,y:int,confidence:double,label:string>>"


def braces(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def ui_elements(documents: DataFrame) -> DataFrame:
    """A3: (call_id, time_s, det_seq, box, text, confidences, class) of element documents (call_id, time_s, body)."""
    e = documents.select("call_id", "time_s", F.posexplode(F.from_json("body", UI_FILE)["elements"]).alias("det_seq", "e"))
    return e.select("call_id", "time_s", "det_seq", *[F.get("e.bbox", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], F.col("e.text").alias("text"), F.coalesce("e.text_confidence", F.lit(0.0)).alias("text_confidence"), F.coalesce("e.interactive_confidence", F.lit(0.0)).alias("interactive_confidence"), F.coalesce("e.class", F.lit("unknown")).alias("class"))


def ui_answers(answers: DataFrame) -> DataFrame:
    """A4: the same from model answers (call_id, time_s, width, height, raw): malformed or tiny boxes go, corners are sorted and
    cut to the image, confidences come from the kind of text and whether it can be used."""
    e = answers.select("call_id", "time_s", "width", "height", F.posexplode(F.from_json(braces(F.col("raw")), UI_ANSWER)["elements"]).alias("det_seq", "e")).where("size(e.box) = 4 and not exists(e.box, v -> v is null)")
    b = F.col("e.box")
    cut = lambda i, j, pick, size: F.greatest(F.lit(0), F.least(pick(F.get(b, F.lit(i)), F.get(b, F.lit(j))).cast("int"), F.col(size)))
    text = F.trim("e.text")
    has = F.coalesce(text, F.lit("")) != ""
    e = e.select("call_id", "time_s", "det_seq", cut(0, 2, F.least, "width").alias("x1"), cut(1, 3, F.least, "height").alias("y1"), cut(0, 2, F.greatest, "width").alias("x2"), cut(1, 3, F.greatest, "height").alias("y2"), F.when(has, text).alias("text"), F.when(~has, 0.0).when(text.startswith("["), 0.6).otherwise(0.95).alias("text_confidence"), F.when(F.col("e.interactive"), 0.85).otherwise(0.2).alias("interactive_confidence"), F.coalesce("e.type", F.lit("unknown")).alias("class"))
    return e.where("x2 - x1 >= 2 and y2 - y1 >= 2")


def points(answers: DataFrame) -> DataFrame:
    """A5: (call_id, vis_seq, time_s, x, y, confidence) of pointing answers (call_id, vis_seq, raw); what isn't JSON has none."""
    bare = F.trim(F.replace(F.replace(F.col("raw"), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    p = answers.select("call_id", "vis_seq", F.explode(F.from_json(bare, POINTS)["points"]).alias("p"))
    return p.select("call_id", "vis_seq", "p.time_s", "p.x", "p.y", "p.confidence")
