"""The chat turn as one plan: new requests to model requests, then answers to log and responses."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators import conversation as conv
from corpusflow.operators.embedding import Embedder
from corpusflow.operators.prompts import HEADER_LINES, model_requests
from corpusflow.plans.retrieve import retrieve_texts
from corpusflow.session import materialize


def open_turns(requests: DataFrame) -> DataFrame:
    """Turns of requests(request_id, session_id, turn_order, message, asked_at): a request without
    a session gets a new one, the request's id becomes the turn's."""
    return conv.assign_sessions(requests).withColumnRenamed("request_id", "turn_id")


def with_past(log: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns with `history` and `context`, the last messages of their session in the log.

    Every turn sees the log as it is, none the other open turns. Tasks keep the last few messages
    of each session before the shuffle, so a session of any length stays small. For few requests
    give the log of their sessions only (a semi join with so small a side needs no shuffle).
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    last = (
        log.withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= conv.HISTORY_MESSAGES)
    )
    message = conv.model_message(F.col("role"), F.col("content"))
    entry = F.struct(F.col("seq"), message.alias("m"), conv.context_line().alias("line"))
    past = last.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("_past"))
    none = F.array().cast(past.schema["_past"].dataType)
    lines = F.slice("_past", -F.least(F.size("_past"), F.lit(conv.REWRITE_MESSAGES)), conv.REWRITE_MESSAGES)
    return (
        turns.join(past, "session_id", "left")
        .withColumn("_past", F.coalesce("_past", none))
        .withColumn("history", F.transform("_past", lambda e: e["m"]))
        .withColumn("context", F.when(F.size("_past") == 0, "").otherwise(
            F.array_join(F.transform(lines, lambda e: e["line"]), "")))
        .withColumn("content", F.col("message"))
        .drop("_past")
    )


def rewrite_requests(log: DataFrame, turns: DataFrame) -> DataFrame:
    """(turn_id, request) to send to a rewriting model: the turns that have history."""
    return conv.rewrite_request(with_past(log, turns)).filter("request is not null").select("turn_id", "request")


def chat_requests(
    log: DataFrame,
    turns: DataFrame,
    vectors: DataFrame,
    base: Column,
    rewrites: DataFrame | None = None,
    embedder: Embedder | None = None,
    header_lines: Sequence[str] = HEADER_LINES,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(model requests, sources) of the turns; rewrites(turn_id, rewritten) serve the search only."""
    past = with_past(log, turns)
    texts = past.withColumn("search_text", F.col("content"))
    if rewrites is not None:
        texts = conv.merge_rewrites(past, rewrites, ["turn_id"])
    queries = texts.select(F.col("turn_id").alias("query_id"), F.col("search_text").alias("query"))
    # Written once: the requests have them, and the responses again.
    sources = materialize(retrieve_texts(queries, vectors, embedder, **options), "chat-sources")
    asked = past.select(F.col("turn_id").alias("query_id"), "content", "history")
    return model_requests(asked, sources, base, header_lines), sources


def close_turns(log: DataFrame, turns: DataFrame, sources: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, responses) after answers(turn_id, answer, answered_at); doing it again adds nothing."""
    return conv.commit_turns(log, turns, answers), conv.responses(turns, sources, answers)
