"""A corpus of calls from its files to event graphs, in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import describe, fusion, targets
from ..operators import transcripts as S
from ..sources import readers
from .held import held


def by_call(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df as a table of the warehouse in buckets by call_id, sorted by it. Tables with the same number of buckets meet on call_id,
    and with spark.sql.requireAllClusterKeysForCoPartition off on call_id and anything else, without an exchange. A call
    lies in one bucket whole, so this suits corpora of many calls, none of which holds more than a task can take; else
    leave the tables as they are: joins in time then spread a long call over its time."""
    df.repartition(buckets, "call_id").write.bucketBy(buckets, "call_id").sortBy("call_id").mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def tables(prefix: str, buckets: int) -> Callable[[DataFrame, str], DataFrame]:
    """For keep of event_graphs: what is used twice goes to tables named prefix and what they hold, in buckets by call."""
    return lambda df, what: by_call(df, f"{prefix}_{what}", buckets)


def event_graphs(documents: DataFrame, events: DataFrame, elements: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events with what was said of them, references without an event) of transcripts (call_id, language, segments),
    visual events and elements. A reference that names the text of the element under an event is likelier to be meant (C2).
    call_id may be of any type that orders. What is said and the pairs are computed once, and kept by keep(rows, name); unless
    that is given, in the shared folder."""
    keep = keep or (lambda df, _: held(df))
    refs = keep(S.instructions(S.segments(documents)), "references")
    seen = targets.targets_at_points(events, elements)
    named = elements.select("call_id", F.col("element_seq").alias("target_seq"), F.col("text").alias("target_text"))
    asked = seen.join(named, ["call_id", "target_seq"], "left").drop("start_s", "end_s", "evidence", "target_seq")
    bound = keep(fusion.resolve(fusion.candidates(refs.drop("text", "speaker"), asked)), "bound")
    return fusion.grounded_events(seen, bound, refs, elements), fusion.unbound(refs, bound)


def from_files(events: DataFrame, transcripts: str, ui: str, out: str) -> None:
    """Reads the transcripts and elements of calls from folders of JSON and writes a graph for each call under out.
    A parser that knows a call by its file sees the same elements at every event, so they are joined into stable ones."""
    spark = events.sparkSession
    looks = readers.seen_at(readers.ui_elements(spark, ui), events)
    elements = held(targets.stable_elements(looks))
    told, alone = event_graphs(readers.transcripts(spark, transcripts), events, elements)
    readers.write_documents(describe.graph_documents(held(told), alone), out)
