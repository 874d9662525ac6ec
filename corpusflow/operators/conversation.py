"""Conversations as a table of messages: bounded history, rewriting, commits, responses.

A session may hold a large share of all messages, so no operator here puts a whole session
into one task. Sessions are cut into blocks of consecutive positions; a block gets copies of
the few messages before it and is then independent of the rest.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import present, strip
from corpusflow.session import materialize

HISTORY_MESSAGES = 20
REWRITE_MESSAGES = 5
BLOCK = 1024


def positions(df: DataFrame, key: str, order: str, out_col: str, block: int = BLOCK) -> DataFrame:
    """0-based, gap-free position of each row within its key, by `order`.

    An integer order counts rows per block of order values (combined before the shuffle), the running
    counts give each block its start, and rows are numbered inside blocks only. Blocks of an order
    with wide gaps hold a row each: number by `sparse_positions` there. Other orders, such
    as times, are always numbered so.
    """
    if not isinstance(df.schema[order].dataType, T.IntegralType):
        return sparse_positions(df, key, order, out_col)
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(key, "_block")
        .agg(F.count("*").alias("_n"))
        .select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(key, "_block").orderBy(order)
    return (
        blocked.join(starts, [key, "_block"])
        .withColumn(out_col, (F.col("_start") + F.row_number().over(inside) - 1).cast("int"))
        .drop("_block", "_start")
    )


def sparse_positions(df: DataFrame, key: str, order: str, out_col: str) -> DataFrame:
    """As `positions`, by any order: rows are sorted in ranges of (key, order) and numbered as they come.

    Each range counts its rows per key; running sums of these counts, one row for each key and range,
    give a key its start in the range. So a key of any share of the rows is numbered by many
    tasks. The sorted rows are written once, so that counts and numbers are of the same ranges.
    Rows of equal order are numbered in any way.
    """
    ranged = df.repartitionByRange(key, order).sortWithinPartitions(key, order)
    ranged = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    starts = starts.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = ranged[key].eqNullSafe(starts["_key"]) & (ranged["_range"] == starts["_of"])
    numbered = ranged.join(starts, same).withColumn(out_col, (F.col("_row") + F.col("_shift")).cast("int"))
    return numbered.select(*df.columns, out_col)


def with_previous(messages: DataFrame, n: int, value: Column, out_col: str, block: int = BLOCK) -> DataFrame:
    """Add the `value` of the last `n` earlier messages of the session, oldest first.

    Messages are numbered first, so `seq` may start anywhere and have gaps: the n messages
    before a block of positions are then the last n of the block before it.
    """
    block = max(block, n)
    at = F.col("_at")
    own = F.floor(at / block)
    copies = F.when(at % block >= block - n, F.array(own, own + 1)).otherwise(F.array(own))
    window = Window.partitionBy("session_id", "_block").orderBy("_at").rowsBetween(-n, -1)
    # A null value keeps its place in the list: inside a struct it is not left out.
    past = F.transform(F.collect_list(F.struct(value.alias("v"))).over(window), lambda s: s["v"])
    return (
        positions(messages, "session_id", "seq", "_at", block)
        .withColumn("_block", F.explode(copies))
        .withColumn(out_col, past)
        .filter(F.col("_block") == own)
        .drop("_block", "_at")
    )


def touched_histories(messages: DataFrame, new: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """(session_id, seq, roles, contents): the last n earlier messages of the user turns whose history the
    messages `new` (session_id, seq), which are among `messages`, have changed or begun: their own and the n after each.

    Only keys of the touched sessions are numbered; contents are read of the messages around new ones.
    """
    new = new.select("session_id", "seq").distinct()
    keys = messages.select("session_id", "seq").join(new.select("session_id").distinct(), "session_id", "left_semi")
    at = materialize(positions(keys, "session_id", "seq", "_at"), "positions")
    hit = at.join(new, ["session_id", "seq"]).select("session_id", F.col("_at").alias("_new"))
    around = hit.select("session_id", "_new", F.explode(F.sequence(F.col("_new") - n, F.col("_new") + n)).alias("_at"))
    around = around.groupBy("session_id", "_at").agg(F.bool_or(F.col("_at") >= F.col("_new")).alias("_touched"))
    needed = at.join(around, ["session_id", "_at"]).select("session_id", "seq", "_touched")
    rows = messages.select("session_id", "seq", "role", "content").join(needed, ["session_id", "seq"])
    past = with_previous(rows, n, F.struct("role", "content"), "_past").filter((F.col("role") == "user") & F.col("_touched"))
    part = lambda name: F.transform("_past", lambda m: m[name]).alias(f"{name}s")
    return past.select("session_id", "seq", part("role"), part("content"))


def model_message(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.array(F.struct(text.alias("text"))).alias("content"))


def with_history(messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """Each user turn with `history`, the last n earlier messages in model form."""
    past = with_previous(messages, n, model_message(F.col("role"), F.col("content")), "history")
    return past.filter(F.col("role") == "user")


def context_line() -> Column:
    return F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")), F.lit("\n"))


def rewrite_context(messages: DataFrame, n: int = REWRITE_MESSAGES) -> DataFrame:
    """Each user turn with `context`: a `role: content` line for each of the last n messages."""
    past = with_previous(messages, n, context_line(), "_lines")
    return past.filter(F.col("role") == "user").withColumn("context", F.array_join("_lines", "")).drop("_lines")


# The labels of the two sections of a rewrite request.
CONTEXT_LABEL = "CONVERSATION HISTORY:"
FOLLOW_UP_LABEL = "FOLLOW-UP:"


def has_history() -> Column:
    """Every line of a context has its line end, so only an empty window gives an empty one."""
    return F.col("context") != ""


def rewrite_request(turns: DataFrame) -> DataFrame:
    """Add `request`, the text asking for a standalone query; null for a turn without history."""
    text = F.concat(
        F.lit(f"{CONTEXT_LABEL}\n"), F.col("context"), F.lit(f"\n\n{FOLLOW_UP_LABEL} "), F.col("content")
    )
    return turns.withColumn("request", F.when(has_history(), text))


def merge_rewrites(turns: DataFrame, rewrites: DataFrame, on: list[str]) -> DataFrame:
    """Add `search_text` to turns of `rewrite_context`: the stripped rewrite where there is history
    and a rewrite, else the message. An empty rewrite stays empty."""
    rewritten = F.when(has_history(), strip(F.col("rewritten")))
    return (
        turns.join(rewrites.select(*on, "rewritten"), on, "left")
        .withColumn("search_text", F.coalesce(rewritten, F.col("content")))
        .drop("rewritten")
    )


def assign_sessions(requests: DataFrame) -> DataFrame:
    """Give requests without a session a new one, derived from the request id: a retried
    task assigns the same."""
    new = F.sha2(F.col("request_id").cast("string"), 256)
    return requests.withColumn("session_id", F.coalesce(present(F.col("session_id")), new))


def new_messages(messages: DataFrame, turns: DataFrame, answers: DataFrame) -> DataFrame:
    """The rows that answered turns add to the log: a user and an assistant message each.

    turns(turn_id, session_id, turn_order int, message, asked_at), answers(turn_id, answer,
    answered_at). A turn without an answer adds nothing.
    """
    answered = turns.join(answers.filter("answer is not null"), "turn_id")
    ends = messages.groupBy("session_id").agg((F.max("seq") + 1).alias("_end"))
    numbered = positions(answered, "session_id", "turn_order", "_at").join(ends, "session_id", "left")
    first = F.coalesce("_end", F.lit(0)) + 2 * F.col("_at")

    def row(seq: Column, role: str, content: str, at: str) -> Column:
        return F.struct(
            seq.cast("int").alias("seq"), F.lit(role).alias("role"),
            F.col(content).alias("content"), F.col(at).alias("timestamp"),
        )

    pair = F.array(
        row(first, "user", "message", "asked_at"), row(first + 1, "assistant", "answer", "answered_at")
    )
    return numbered.select("session_id", "turn_id", F.explode(pair).alias("m")).select("session_id", "m.*", "turn_id")


def commit_turns(messages: DataFrame, turns: DataFrame, answers: DataFrame) -> DataFrame:
    """The log after the answered turns, whose messages carry their `turn_id`.

    A turn already in the log is not committed again, so a rerun changes nothing."""
    if "turn_id" in messages.columns:
        done = messages.select("turn_id").filter("turn_id is not null").distinct()
        turns = turns.join(done, "turn_id", "left_anti")
    return messages.unionByName(new_messages(messages, turns, answers), allowMissingColumns=True)


def sources_per_query(sources: DataFrame, value: Column, out_col: str) -> DataFrame:
    """`value` of each query's sources in rank order; retrieval bounds their number."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", value.alias("v"))))
    return sources.groupBy("query_id").agg(F.transform(ranked, lambda s: s["v"]).alias(out_col))


def responses(turns: DataFrame, sources: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per answered turn: response, session, sources in rank order, retrieval_used."""
    source = F.struct("id", "title", "source_path", "snippet", "doc_type", "chunk_index", "distance")
    listed = sources_per_query(sources, source, "_s").withColumnRenamed("query_id", "turn_id")
    return (
        turns.join(answers.filter("answer is not null"), "turn_id")
        .join(listed, "turn_id", "left")
        .select(
            "turn_id",
            F.col("answer").alias("response"),
            "session_id",
            F.coalesce("_s", F.array().cast(listed.schema["_s"].dataType)).alias("sources"),
            F.col("_s").isNotNull().alias("retrieval_used"),
        )
    )


def history(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages of the asked sessions, one row each; an unknown session gives one row
    without a message.

    A semi join and an anti join rather than an outer one: adaptive execution can split a
    long session in the first, and the second sees each session id once.
    """
    asked = sessions.select("session_id").distinct()
    found = messages.join(asked, "session_id", "left_semi")
    unknown = asked.join(messages.select("session_id").distinct(), "session_id", "left_anti")
    return found.unionByName(unknown, allowMissingColumns=True)
