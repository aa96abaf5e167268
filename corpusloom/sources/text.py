"""Readers of raw text and JSON lines, and of log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import present, strip

#: Fixed value: kinds of files, in reading order.
EXTENSIONS = (".jsonl", ".json", ".txt")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def _raw(spark: SparkSession, path: str, extension: str, whole: bool) -> DataFrame:
    """File, line and bytes made valid text. Files are read where they are, below any folder."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{extension}")
    if whole:
        rows = reader.format("binaryFile").load(path).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("line_no"), F.col("content").alias("raw"))
    else:
        text = reader.option("lineSep", "\n").text(path)
        rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").cast("binary").alias("raw"))
    return rows.withColumn("text", F.make_valid_utf8(F.col("raw").cast("string"))).drop("raw")


def read_documents(spark: SparkSession, path: str, text_key: str = "text", extensions: tuple[str, ...] = EXTENSIONS, bad: str = "drop") -> DataFrame:
    """(file, file_rank, line_no, text) of all documents below ``path``.

    JSON lines give the string at ``text_key``; a ``.txt`` file is one stripped document. Blank lines, lines that are no
    JSON object, and missing or empty texts are dropped; with ``bad="keep"`` they stay with a null text. Order columns:
    kind of file, file, line (rising within a file). No file at all is an error.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    parts = []
    for rank, extension in enumerate(extensions):
        if extension == ".txt":
            rows = _raw(spark, path, extension, True).withColumn("text", strip(F.col("text")))
        else:
            rows = _raw(spark, path, extension, False).drop("block").filter(strip(F.col("text")) != "")
            value = F.try_variant_get(F.try_parse_json(F.col("text")), f"$.{text_key}", "string")
            is_object = F.schema_of_variant(F.try_parse_json(F.col("text"))).startswith("OBJECT")
            rows = rows.withColumn("text", F.when(is_object, value))
        parts.append(rows.select("file", F.lit(rank).alias("file_rank"), "line_no", "text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not out.limit(1).count() and not _any_file(spark, path, extensions):
        raise FileNotFoundError(f"no {', '.join(extensions)} below {path}")
    return out.filter(present(F.col("text"))) if bad == "drop" else out


def _any_file(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> bool:
    glob = "*{" + ",".join(extensions) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return bool(found.select("path").limit(1).count())


def count_bad_lines(spark: SparkSession, path: str, text_key: str = "text") -> DataFrame:
    """Lines by file that hold no text."""
    return read_documents(spark, path, text_key, (".jsonl", ".json"), "keep").filter(F.col("text").isNull()).groupBy("file").agg(F.count(F.lit(1)).alias("bad_lines"))


MESSAGE = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
CONVERSATION = T.StructType([T.StructField("messages", MESSAGE), T.StructField("conversation", MESSAGE)])
PAIR_TOKENS = T.StructType(
    [T.StructField(f"{s}_{k}", T.ArrayType(T.IntegerType())) for s in ("chosen", "rejected") for k in ("full_ids", "loss_mask", "ids")] + [T.StructField("prompt_ids", T.ArrayType(T.IntegerType()))]
)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of JSON lines; a line that cannot be parsed is an error. ``conversation`` is another name of ``messages``."""
    rows = spark.read.schema(CONVERSATION).option("mode", "FAILFAST").json(path)
    return rows.select(F.coalesce("messages", "conversation").alias("messages"))


def turns(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) from nested messages."""
    return conversations.select(conv_id, F.posexplode("messages").alias("turn", "m")).select(conv_id, F.col("turn").cast("long"), "m.role", F.col("m.content").alias("text"))


def read_token_pairs(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Tokenized preference pairs of JSON lines, the first ``most`` by file and line."""
    rows = spark.read.schema(PAIR_TOKENS).option("mode", "FAILFAST").json(path)
    if not most:
        return rows
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    return rows.select("*", *place).orderBy("_file", "_block", "_line").limit(most).drop("_file", "_block", "_line")  # a limit is the feature


def read_raw_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Raw pairs; a completion is a string or a list of messages, so both columns are there for each side."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "").select(F.parse_json("value").alias("v"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    kind = "array<struct<role string, content string>>"
    cols = [F.coalesce(get("$.prompt", kind), get("$.messages_prompt", kind)).alias("prompt")]
    for side in ("chosen", "rejected"):
        cols += [F.when(F.schema_of_variant(F.variant_get("v", f"$.{side}", "variant")) == "STRING", get(f"$.{side}", "string")).alias(f"{side}_text"), get(f"$.{side}", kind).alias(f"{side}_msgs")]
    return lines.select(*cols)


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    """(line_no, value) of the first of ``paths`` that exists; no rows if none does."""
    for path in paths:
        if _exists(spark, path):
            return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.make_valid_utf8("value").alias("value"))
    return spark.createDataFrame([], "line_no long, value string")
