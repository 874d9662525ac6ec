"""Conversation transcripts: one JSON array per session, or an append-only message log."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.schemas import MESSAGES, TRANSCRIPT_ENTRY

SESSION_BUCKETS = 64
PART_MESSAGES = 10_000


def _exploded(arrays: DataFrame, first_seq) -> DataFrame:
    """Message rows of (session_id, value): value is the text of a JSON array."""
    entries = F.from_json("value", T.ArrayType(TRANSCRIPT_ENTRY), {"mode": "FAILFAST"})
    return arrays.select("*", F.posexplode(entries).alias("_i", "m")).select(
        "session_id",
        (first_seq + F.col("_i")).cast("int").alias("seq"),
        "m.role",
        "m.content",
        F.to_timestamp_ntz("m.timestamp").alias("timestamp"),
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the files `{session}.json` in a folder; a malformed file is an error."""
    # The file name comes URL-encoded; a plus sign in it is none.
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(
        "value", F.regexp_replace(name, r"\.json\z", "").alias("session_id")
    )
    return _exploded(files, F.lit(0))


def transcript_json(messages: DataFrame, part_messages: int = PART_MESSAGES) -> DataFrame:
    """(session_id, first_seq, value): messages as JSON arrays in order, the first's position beside.

    A session of up to `part_messages` messages is one array. A longer one goes on in further
    rows, so that the size of a row stays bounded; any reader puts them together by `first_seq`.
    `seq` must be gap-free (`positions` numbers other data).
    """
    entry = F.struct(
        "seq",
        F.struct(
            "role", "content",
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        ).alias("m"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["m"])
    return (
        messages.groupBy("session_id", F.floor(F.col("seq") / part_messages).alias("_part"))
        .agg(F.min("seq").cast("long").alias("first_seq"), F.to_json(ordered).alias("value"))
        .drop("_part")
    )


def parse_transcript_json(arrays: DataFrame) -> DataFrame:
    """Inverse of `transcript_json`."""
    return _exploded(arrays, F.col("first_seq"))


def write_transcripts(messages: DataFrame, path: str, part_messages: int = PART_MESSAGES) -> None:
    """Export sessions as JSON arrays. A session exported before is replaced as a whole, sessions
    not among `messages` stay: each export is a folder, and per session the last one counts."""
    spark = messages.sparkSession
    earlier = _export_numbers(spark, path)
    number = earlier[-1] + 1 if earlier else 1
    transcript_json(messages, part_messages).write.parquet(f"{path}/export={number}")


def _export_numbers(spark: SparkSession, path: str) -> list[int]:
    try:
        exports = spark.read.schema("first_seq bigint, export bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r.export for r in exports.select("export").distinct().collect())


def read_written_transcripts(
    spark: SparkSession, path: str, session_type: T.DataType = T.StringType()
) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("session_id", session_type),
            T.StructField("first_seq", T.LongType()),
            T.StructField("value", T.StringType()),
            T.StructField("export", T.LongType()),
        ]
    )
    arrays = spark.read.schema(schema).parquet(path)
    last = arrays.groupBy("session_id").agg(F.max("export").alias("export"))
    return parse_transcript_json(arrays.join(last, ["session_id", "export"], "left_semi"))


def append_messages(messages: DataFrame, path: str, buckets: int = SESSION_BUCKETS) -> None:
    """Append to the log. Partitioned by a hash of the session, so reading one session touches
    one bucket, and by the number of buckets, which each append may choose; rebalanced, so that
    a bucket gets files of the advisory size rather than one of every task."""
    (
        messages.withColumn("buckets", F.lit(buckets))
        .withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
        .hint("rebalance", "bucket")
        .write.mode("append").partitionBy("buckets", "bucket").parquet(path)
    )


def read_messages(spark: SparkSession, path: str, schema: T.StructType = MESSAGES) -> DataFrame:
    """The log, with `buckets` and `bucket` for pruning."""
    stored = T.StructType([*schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("buckets", "bucket"))])
    return spark.read.schema(stored).parquet(path)


def session_messages(log: DataFrame, session_id) -> DataFrame:
    """One session's messages; the bucket condition prunes the scan to one folder per number of
    buckets the log was written with."""
    # The bucket is a hash of the stored type, which a literal need not have.
    session = F.lit(session_id).cast(log.schema["session_id"].dataType)
    return log.filter(
        (F.col("bucket") == F.pmod(F.xxhash64(session), F.col("buckets"))) & (F.col("session_id") == session)
    )
