"""The message log: appended to in commits, so that turns of two writers never share a position.

Layout below the log's path: `data/run=<r>` (one append, or several merged: then partitioned by a hash
bucket of the session and sorted by session and position) and `commits/<number>.json`: the runs that
make up the log, oldest first, and how far each stream has been appended. A commit's file is created
exclusively; a writer that finds its number taken reads the log again. When FAN runs have been merged
equally often they are merged into one, so a message is rewritten once for each power of FAN.
"""

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.conversation import new_messages
from corpusflow.schemas import MESSAGES
from corpusflow.sources.commits import CommitConflict, create_file, file_names, read_file

FAN = 16
BUCKETS = 64


class Run(NamedTuple):
    """level: how often its messages have been merged; 0 is an append as it came."""

    name: str
    level: int


class Log(NamedTuple):
    number: int
    buckets: int
    runs: tuple[Run, ...]
    streams: dict[str, int]


def logged(messages: T.StructType = MESSAGES) -> T.StructType:
    """Messages with the turn that brought them."""
    return T.StructType([*messages.fields, T.StructField("turn_id", T.StringType())])


def current_log(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Log:
    """The last commit; the log without messages if there is none."""
    names = sorted(n for n in file_names(spark, f"{path}/commits") if n.endswith(".json") and not n.startswith("_"))
    if not names:
        return Log(0, buckets, (), {})
    row = json.loads(read_file(spark, f"{path}/commits/{names[-1]}"))
    return Log(int(names[-1][:-5]), row["buckets"], tuple(Run(*r) for r in row["runs"]), row["streams"])


def _commit(spark: SparkSession, path: str, log: Log) -> int:
    create_file(spark, f"{path}/commits/{log.number:012d}.json", json.dumps(log._asdict()))
    return log.number


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")


def read_log(spark: SparkSession, path: str, log: Log | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The messages of a commit, by default the last, with `bucket` for pruning."""
    log = log or current_log(spark, path)
    schema = schema or logged()
    stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    parts = [spark.createDataFrame([], stored)]
    new = [f"{path}/data/run={r.name}" for r in log.runs if r.level == 0]
    if new:
        parts.append(spark.read.schema(schema).parquet(*new).withColumn("bucket", _bucket(log.buckets)))
    merged = [f"{path}/data/run={r.name}" for r in log.runs if r.level > 0]
    if merged:
        with_run = T.StructType([*stored.fields, T.StructField("run", T.StringType())])
        parts.append(spark.read.schema(with_run).option("basePath", f"{path}/data").parquet(*merged).select(*stored.names))
    return reduce(DataFrame.unionByName, parts)


def session(messages: DataFrame, log: Log, session_id) -> DataFrame:
    """One session's messages; the bucket prunes the scan to one folder of each merged run."""
    # The bucket is a hash of the stored type, which a literal need not have.
    value = F.lit(session_id).cast(messages.schema["session_id"].dataType)
    return messages.filter((F.col("bucket") == F.pmod(F.xxhash64(value), F.lit(log.buckets))) & (F.col("session_id") == value))


def _append(
    spark: SparkSession, path: str, rows: Callable[[Log], DataFrame | None], schema: T.StructType, streams: dict[str, int], buckets: int
) -> int:
    """Commit what `rows` gives for the log as it is read; again if another writer was first."""
    while True:
        log = current_log(spark, path, buckets)
        if streams and all(log.streams.get(s, -1) >= n for s, n in streams.items()):
            return log.number
        name = uuid.uuid4().hex
        new = rows(log).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        new.write.parquet(f"{path}/data/run={name}")
        try:
            number = _commit(spark, path, log._replace(number=log.number + 1, runs=(*log.runs, Run(name, 0)), streams={**log.streams, **streams}))
        except CommitConflict:
            continue
        merge(spark, path, schema)
        return number


def append_messages(
    spark: SparkSession, path: str, messages: DataFrame, schema: T.StructType | None = None, stream: str = "", batch: int = 0, buckets: int = BUCKETS
) -> int:
    """Append numbered messages; a batch of a stream that was appended before is not appended again."""
    if "turn_id" not in messages.columns:
        messages = messages.withColumn("turn_id", F.lit(None).cast("string"))
    return _append(spark, path, lambda log: messages, schema or logged(), {stream: batch} if stream else {}, buckets)


def commit_turns(spark: SparkSession, path: str, turns: DataFrame, answers: DataFrame, schema: T.StructType | None = None) -> int:
    """Append the messages of answered turns (see `new_messages`) after those of their sessions.

    Positions follow the log that the commit names; if another writer commits first they are given
    again. A turn that is in the log already is not committed again, so a rerun changes nothing.
    """
    schema = schema or logged()

    def rows(log: Log) -> DataFrame:
        stored = read_log(spark, path, log, schema)
        mine = stored.join(turns.select("session_id").distinct(), "session_id", "left_semi")
        done = mine.filter("turn_id is not null").select("turn_id").distinct()
        return new_messages(mine, turns.join(done, "turn_id", "left_anti"), answers)

    return _append(spark, path, rows, schema, {}, BUCKETS)


def merge(spark: SparkSession, path: str, schema: T.StructType | None = None) -> None:
    """Merge FAN runs of one level into one of the next, sorted by session, as long as there are so many."""
    schema = schema or logged()
    while True:
        log = current_log(spark, path)
        level = next((n for n in sorted({r.level for r in log.runs}) if sum(r.level == n for r in log.runs) >= FAN), None)
        if level is None:
            return
        old = [r for r in log.runs if r.level == level]
        name = uuid.uuid4().hex
        (
            read_log(spark, path, log._replace(runs=tuple(old)), schema)
            .hint("rebalance", "bucket").sortWithinPartitions("bucket", "session_id", "seq")
            .write.partitionBy("bucket").parquet(f"{path}/data/run={name}")
        )
        while True:
            now = current_log(spark, path)
            if not set(old) <= set(now.runs):
                break  # somebody else has merged them
            runs = (Run(name, level + 1), *(r for r in now.runs if r not in old))
            try:
                _commit(spark, path, now._replace(number=now.number + 1, runs=runs))
                break
            except CommitConflict:
                continue
