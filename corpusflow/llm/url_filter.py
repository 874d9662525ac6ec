"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

Two kinds of entries are listed. A site or rule is a host and a path; it fits the host and its
subdomains, and paths that start with its path. A URL is listed in canonical form and fits the pages
whose canonical form is equal, whatever their scheme, query and other spelling. Every page asks for its
host's suffixes with its path's prefixes and for its canonical form; the filter lets through the listed
ones and few others, and a join with the list removes these. The filter's size follows the list up to
MAX_BLOCKS; beyond that more false positives reach the join, which stays exact.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import mix

WORDS = 8  # a block has 8 words of 32 bits; a key sets one bit in each word of one block
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 18

# A page is junk if it has more than so many runs of a symbol for every 1,000 characters.
SYMBOL_RUNS = r"###|\*\*\*|\$\$\$|%%%"
JUNK_RUNS = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without `://` and for a null."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column | str, path: Column | str) -> tuple[Column, Column]:
    """Canonical host and path of a URL: no default port, no leading `www.` or `m.`; no index page,
    no `.htm` or `.html`, no slashes at the end."""
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)\z", ""), r"^(www|m)\.", "")
    return host, F.regexp_replace(path, r"(/index\.html?|\.html?)?/*\z", "")


def junk_urls(pages: DataFrame) -> DataFrame:
    """Distinct canonical (host, path) of the pages (url, html) that are mostly symbols. Pages without
    html or host give none."""
    host, path = host_and_path("url")
    junk = pages.where(F.regexp_count("html", F.lit(SYMBOL_RUNS)) * 1000 > JUNK_RUNS * F.length("html"))
    junk = junk.select(host.alias("host"), path.alias("path")).where("host != ''")
    host, path = canonical("host", "path")
    return junk.select(host.alias("host"), path.alias("path")).distinct()


def _places(key: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and the bit that it has in each word."""
    h = mix(key.view(np.uint64))
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = mix(h + np.uint64(1))
    bits = np.stack([(low >> np.uint64(5 * i)) & np.uint64(31) for i in range(WORDS)], axis=1)
    return block.astype(np.int64), bits.astype(np.uint32)


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """Blocked Bloom filter of `keys` (key long), one row of WORDS words for each block. Blocks are
    put together by Spark; at most MAX_BLOCKS rows reach the driver."""
    blocks = int(min(MAX_BLOCKS, max(1, -(-keys.count() * BITS_PER_KEY // (32 * WORDS)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block, bits = _places(batch["key"].to_numpy(np.int64), blocks)
            words = (np.uint32(1) << bits).view(np.int32)
            yield pd.DataFrame({"block": block} | {f"w{i}": words[:, i] for i in range(WORDS)})

    schema = "block long, " + ", ".join(f"w{i} int" for i in range(WORDS))
    merged = keys.select("key").mapInPandas(run, schema).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
    table = np.zeros((blocks, WORDS), np.uint32)
    for row in merged.collect():
        table[row.block] = np.array(row[1:], np.int32).view(np.uint32)
    return table


def maybe_listed(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    block, bits = _places(key, len(table))
    return ((table[block] >> bits) & 1).all(axis=1)


def _asked(host: Column, path: Column, is_url: bool) -> Column:
    return F.struct(host.alias("of_host"), path.alias("of_path"), F.lit(is_url).alias("is_url"))


def filter_urls(pages: DataFrame, listed: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed_as) for every row of `pages` (page_id, url).

    `listed` has host, path, verdict (allow or block) and is_rule; `urls` has the canonical host and path
    of blocked URLs. Both are read more than once, so give stored tables. Of the rules that fit a page the
    longest decides (host and path together; then the longer host; then block) and is given as
    `rule`. Without one, the page is blocked if its URL is listed or an entry that isn't a rule fits with the
    verdict block, else allowed; `listed_as` is the longest such entry. Entries with a null are ignored,
    repeated ones count once. A null url, or one without `://`, has an empty host and path and fits
    nothing. Repeated pages are judged each; other columns are ignored.
    """
    spark = pages.sparkSession
    entries = listed.select("host", "path", "verdict", "is_rule", F.lit(False).alias("is_url"))
    # At most as many numbers as the longest listed path has characters.
    lengths = sorted(entries.dropna().agg(F.collect_set(F.length("path"))).first()[0])
    if urls is not None:
        blocked = [F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"), F.lit(True).alias("is_url")]
        entries = entries.union(urls.select("host", "path", *blocked))
    entries = entries.dropna().distinct()
    keys = entries.select(F.xxhash64("host", "path", "is_url").alias("key")).distinct()
    table = spark.sparkContext.broadcast(bloom_filter(keys))

    host, path = host_and_path("url")
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring("path", F.lit(1), n))
    sites = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _asked(h, p, False))))
    probes = sites if urls is None else F.concat(sites, F.array(_asked(*canonical("host", "path"), True)))
    asked = (
        pages.where("host != ''")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.inline(probes))
        .withColumn("key", F.xxhash64("of_host", "of_path", "is_url"))
    )

    @F.pandas_udf("boolean")
    def passes(key: pd.Series) -> pd.Series:
        return pd.Series(maybe_listed(key.to_numpy(np.int64), table.value))

    possible = asked.where(passes("key"))
    named = entries.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), F.col("verdict").alias("says"), "is_rule", "is_url")
    hits = possible.join(named, ["of_host", "of_path", "is_url"])
    rank = F.struct(F.length("of_host") + F.length("of_path"), F.length("of_host"), F.col("says") == "block")
    best = lambda what, which: F.max_by(F.when(which, what), F.when(which, rank))
    entry, rule = F.concat("of_host", "of_path"), F.col("is_rule")
    verdicts = hits.groupBy("host", "path").agg(
        best(entry, rule).alias("rule"),
        best(F.col("says"), rule).alias("rule_says"),
        best(entry, ~rule).alias("listed_as"),
        F.bool_or(~rule & (F.col("says") == "block")).alias("listed"),
    )
    method = F.when(F.col("listed"), "block").otherwise("allow")
    out = pages.join(verdicts, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_says", method).alias("verdict"), "listed_as")
