"""Files of calls: transcripts, elements seen on screen, ground truth and event graphs as JSON, and writers of what is made of them.

A file holds one document; the call's name is the file's name without its ending, and the readers spread over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transcripts import TRANSCRIPT

ELEMENTS = "elements array<struct<bbox:array<int>,text:string,text_confidence:double,interactive_confidence:double,class:string>>"
TRUTH = (
    "video_id string, words array<struct<word:string,start:double,end:double>>, events array<struct<speaker:string,action_utterance:string,utterance_start_s:double,"
    "utterance_end_s:double,event_time_s:double,event_type:string,point:array<int>,target_bbox:array<int>,ui_target_text:string,observable:boolean>>"
)
GRAPH = (
    "schema_version string, events array<struct<event_id:string,type:string,temporal:struct<start_s:double,peak_s:double,end_s:double,confidence:double>,"
    "spatial:struct<point_xy_px:array<int>,point_normalized:array<double>,confidence:double>,target:struct<object_id:string,class:string,text:string,bbox_xyxy_px:array<int>>,"
    "audio_references:array<struct<audio_ref_id:string,speaker_id:string,start_s:double,end_s:double,transcript:string,asr_confidence:double,relation:string>>,"
    "evidence:array<struct<source:string,confidence:double>>,grounding_status:string,overall_confidence:double>>,"
    "unbound_audio_references array<struct<audio_ref_id:string,speaker_id:string,start_s:double,end_s:double,transcript:string,relation:string>>"
)


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of the JSON files at path with the columns of schema, and file_name, the file's name without its ending.
    Keys that a document lacks are null; a file that is no such JSON has its text in column corrupt and nulls elsewhere."""
    read = spark.read.schema(f"{schema}, corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "corrupt").json(path)
    return read.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("file_name"), "*")


def malformed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """documents() of the files at path that hold no such document: what the readers below leave out. Spark refuses to prune it
    to file_name and corrupt alone."""
    return documents(spark, path, schema).where("corrupt is not null")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """A1: (call_id, language, segments) of word-timed transcripts; call_id is the file's name."""
    return documents(spark, path, TRANSCRIPT).select(F.col("file_name").alias("call_id"), "language", F.coalesce("segments", F.array().cast("array<" + _element(TRANSCRIPT, "segments") + ">")).alias("segments"))


def ui_elements(spark: SparkSession, path: str) -> DataFrame:
    """A3: a row per element: call_id, det_seq, x1, y1, x2, y2, text, text_confidence, interactive_confidence, class. A box of
    other than four numbers is left out; missing confidences are 0, a missing class is unknown."""
    e = documents(spark, path, ELEMENTS).select(F.col("file_name").alias("call_id"), F.posexplode("elements").alias("det_seq", "e")).where(F.size("e.bbox") == 4)
    box = [F.col("e.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return e.select("call_id", "det_seq", *box, "e.text", F.coalesce("e.text_confidence", F.lit(0.0)).alias("text_confidence"), F.coalesce("e.interactive_confidence", F.lit(0.0)).alias("interactive_confidence"), F.coalesce("e.class", F.lit("unknown")).alias("class"))


def seen_at(elements: DataFrame, looks: DataFrame) -> DataFrame:
    """A3: what a parser that knows a call by its file sees at each look (call_id, time_s): all its elements, with the time."""
    return elements.join(looks.select("call_id", "time_s").distinct(), "call_id")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A row per true event: call_id (the video's id, else the file's name), gt_idx and the event's fields."""
    t = documents(spark, path, TRUTH)
    return t.select(F.coalesce("video_id", "file_name").alias("call_id"), F.posexplode("events").alias("gt_idx", "e")).select("call_id", "gt_idx", "e.*")


def event_graphs(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, events, unbound_audio_references) of event graphs; call_id is the file's name."""
    return documents(spark, path, GRAPH).select(F.col("file_name").alias("call_id"), "events", "unbound_audio_references")


def _element(schema: str, column: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)[column].dataType.elementType.simpleString()


def write_documents(df: DataFrame, path: str, text: str = "document") -> None:
    """A text per call under path, in a folder call_id=..., written anew for the calls of df only."""
    (df.select("call_id", F.col(text).alias("value")).repartition("call_id").write.partitionBy("call_id").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").text(path))


def write_package(pages: DataFrame, path: str) -> None:
    """The files of article packages (call_id, path, content) as Parquet by call; a call that is written again replaces its own."""
    pages.select("call_id", "path", "content").repartition("call_id").write.partitionBy("call_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
