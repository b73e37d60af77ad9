"""Sources and sinks beyond Parquet: JSON lines, text files, transcripts of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import text as tx
from tessellum.functions import vectors as vec

#: Names of evaluation entries in JSON lines.
GROUND_TRUTH = "question string, expected_answer string, expected_source_pages array<int>"


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A JSON-lines file with a given schema; one bad line fails a strict scan, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, mime, content_type, text) of files; text is null for other types than plain text.

    Bytes that are no UTF-8 fail the job.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(ext.isin("txt", "md"), "text/plain").when(ext == "pdf", "application/pdf").when(ext.isin("mp3", "wav"), "audio/mpeg").when(ext == "mp4", "video/mp4")
    kind = tx.content_type(mime)
    return f.select("path", F.col("length").alias("size_bytes"), mime.alias("mime"), kind.alias("content_type"), F.when(kind == "Text", F.validate_utf8(F.decode("content", "UTF-8"))).alias("text"))


def shard_names(index_json: str):
    """Distinct, sorted file names of a weight index (a Column -> Column over JSON text)."""
    m = F.from_json(F.get_json_object(index_json, "$.weight_map"), "map<string,string>")
    return F.array_sort(F.array_distinct(F.map_values(m)))


def speech_windows(samples: DataFrame, seconds: int = 30, rate: int = 16_000, floor: float = 0.01) -> DataFrame:
    """(id, window, start_time, end_time, samples) of audio (id, samples array<float>): tumbling windows that are not silent.

    The last window is padded with zeros; windows whose root mean square is under ``floor`` are skipped.
    """
    size = seconds * rate
    starts = F.sequence(F.lit(0), F.size("samples") - 1, F.lit(size))
    x = samples.where(F.size("samples") > 0).select("id", F.posexplode(F.transform(starts, lambda s: F.slice("samples", s + 1, size))).alias("window", "part"))
    padded = F.concat("part", F.array_repeat(F.lit(0.0).cast("float"), F.lit(size) - F.size("part")))
    x = x.select("id", "window", (F.col("window") * float(seconds)).alias("start_time"), ((F.col("window") + 1) * float(seconds)).alias("end_time"), padded.alias("samples"))
    return x.where(vec.rms(F.col("samples")) >= floor)


def search_results(reply, n: int):
    """A numbered list of the first n results of a web search reply (Column of JSON -> Column)."""
    items = F.slice(F.from_json(F.get_json_object(reply, "$.web.results"), "array<struct<title:string,url:string,description:string>>"), 1, n)
    return F.array_join(F.transform(items, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["title"], F.lit("\n   "), r["url"], F.lit("\n   "), F.coalesce(r["description"], F.lit("")))), "\n")


def tool_texts(reply):
    """The text parts of a tool server's reply, a line each (Column of JSON -> Column)."""
    parts = F.from_json(F.get_json_object(reply, "$.content"), "array<struct<type:string,text:string>>")
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
