"""From raw hits to ranked, diversified source rows.

All ranks are windows over one query's hits, at most the number fetched; they share the
partitioning by query_id, so the whole chain needs a single exchange.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import lexical_score, present, snippet

LEXICAL_WEIGHT = 0.5
RETURN_N = 4
CHUNKS_PER_DOC = 2


def scoring_distance(distance: Column, zero_is_missing: bool = True) -> Column:
    """Distance used for scoring: 1.0 where missing, and by default where it is zero."""
    missing = distance.isNull()
    if zero_is_missing:
        missing = missing | (distance == 0)
    return F.when(missing, F.lit(1.0)).otherwise(distance)


def combined_score(distance: Column, lexical: Column, lexical_weight: float = LEXICAL_WEIGHT) -> Column:
    return (F.lit(1.0) - distance) + lexical * F.lit(float(lexical_weight))


def doc_key(source_path: Column, title: Column) -> Column:
    return F.coalesce(present(source_path), present(title), F.lit("unknown"))


def score_hits(
    hits: DataFrame,
    lexical_weight: float = LEXICAL_WEIGHT,
    zero_is_missing: bool = True,
) -> DataFrame:
    """Add lexical, score and doc_key to hits that carry their query's text."""
    return (
        hits.withColumn("lexical", lexical_score(F.col("query"), F.col("chunk_text")))
        .withColumn("_d", scoring_distance(F.col("distance"), zero_is_missing))
        .withColumn("score", combined_score(F.col("_d"), F.col("lexical"), lexical_weight))
        .drop("_d")
        .withColumn("doc_key", doc_key(F.col("source_path"), F.col("title")))
    )


def rerank(scored: DataFrame) -> DataFrame:
    """Add `score_rank`: best score first, ties in search order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "raw_rank")
    return scored.withColumn("score_rank", F.row_number().over(order))


def mark_kept(ranked: DataFrame, cap: int = CHUNKS_PER_DOC, n: int = RETURN_N) -> DataFrame:
    """Add doc_rank, allowed (within its document's cap), taken (allowed rows up to here)
    and kept (allowed and among the first n)."""
    per_doc = Window.partitionBy("query_id", "doc_key").orderBy("score_rank")
    so_far = Window.partitionBy("query_id").orderBy("score_rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("doc_rank", F.row_number().over(per_doc))
        .withColumn("allowed", F.col("doc_rank") <= cap)
        .withColumn("taken", F.sum(F.col("allowed").cast("int")).over(so_far))
        .withColumn("kept", F.col("allowed") & (F.col("taken") <= n))
    )


def diversify(ranked: DataFrame, cap: int = CHUNKS_PER_DOC, n: int = RETURN_N) -> DataFrame:
    """In rank order, at most `cap` hits per document and `n` in all; `rank` counts from 1."""
    marked = mark_kept(ranked, cap, n)
    return (
        marked.filter("kept")
        .withColumn("rank", F.col("taken").cast("int"))
        .drop("doc_rank", "allowed", "taken", "kept")
    )


def retrieval_stats(ranked: DataFrame, cap: int = CHUNKS_PER_DOC, n: int = RETURN_N) -> DataFrame:
    """Per query: hits, results, hits passed over by the cap before the n-th result, documents."""
    passed_over = ~F.col("allowed") & (F.col("taken") < n)
    return (
        mark_kept(ranked, cap, n)
        .groupBy("query_id")
        .agg(
            F.count("*").alias("raw_count"),
            F.count_if("kept").alias("final_count"),
            F.count_if(passed_over).alias("dropped_by_cap"),
            F.count_if(F.col("kept") & (F.col("doc_rank") == 1)).alias("docs_represented"),
        )
    )


def to_sources(kept: DataFrame, max_chars: int = 280) -> DataFrame:
    """Source rows; a hit without a key gets a stable id made from its content."""
    stable = F.sha2(F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("rank").cast("string"),
                                F.coalesce("source_path", F.lit("")), F.coalesce("chunk_text", F.lit(""))), 256)
    return kept.select(
        "query_id",
        "rank",
        F.coalesce(present(F.col("key").cast("string")), stable).alias("id"),
        "title",
        "source_path",
        snippet(F.col("chunk_text"), max_chars).alias("snippet"),
        "doc_type",
        "chunk_index",
        "distance",
    )
