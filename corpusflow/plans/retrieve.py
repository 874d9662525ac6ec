"""Retrieve: a table of queries to ranked source rows."""

from pyspark.sql import DataFrame

from corpusflow.operators.embedding import Embedder, embed
from corpusflow.operators.knn import knn
from corpusflow.operators.rerank import CHUNKS_PER_DOC, RETURN_N, diversify, rerank, score_hits, to_sources
from corpusflow.schemas import METADATA

FETCH_N = 12


def search(queries: DataFrame, vectors: DataFrame, fetch_n: int = FETCH_N, **knn_options) -> DataFrame:
    """Reranked hits of queries(query_id, query, embedding): the wide search, then scoring of
    its few survivors."""
    scoring = {o: knn_options.pop(o) for o in ("lexical_weight", "zero_is_missing") if o in knn_options}
    hits = knn(queries, vectors, fetch_n, metadata=METADATA, **knn_options)
    with_text = hits.join(queries.select("query_id", "query"), "query_id")
    return rerank(score_hits(with_text, **scoring))


def retrieve(
    queries: DataFrame,
    vectors: DataFrame,
    fetch_n: int = FETCH_N,
    return_n: int = RETURN_N,
    cap: int = CHUNKS_PER_DOC,
    max_chars: int = 280,
    **options,
) -> DataFrame:
    """Source rows per query, best first. Options: metric, max_distance, enabled, dim,
    lexical_weight, zero_is_missing; fetch, which with `vectors` comes from `open_index`."""
    ranked = search(queries, vectors, fetch_n, **options)
    return to_sources(diversify(ranked, cap, return_n), max_chars)


def retrieve_texts(queries: DataFrame, vectors: DataFrame, embedder: Embedder | None = None, **options) -> DataFrame:
    """As `retrieve`, for queries(query_id, query) that have no vector yet."""
    return retrieve(embed(queries, "query", embedder), vectors, **options)
