"""Sharding by balanced label propagation.

Documents are linked through hubs (here: equal texts). Each hub's documents start where their own
hashes put them. In every round the documents of a hub in one shard ask to move to the shard that
holds most of the hub, among those that hold more of it and could take the requests of the round before. All
requests of a round are weighed together, by prices of the shards: what a shard takes must fit its quota
with what leaves it. So links stop being cut while sizes stay even, and a hub
above the quota gathers in a few shards. All of this works on one row per hub and home
shard with a count, never on a row per link. Documents without links fill the shards up. At the end
documents are put in the order of the shards in which they ended and cut into shards of equal counts, which
moves some documents over the border of their shard.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize

SHARDS = 40
OVERHEAD = 16
ROUNDS = 10
# Steps of the prices in a round, and how sharply a request is decided by its gain.
_PRICE_TURNS, _SHARPNESS = 400, 4


def _home(shards: int):
    return F.pmod(F.xxhash64("doc_id", "hub"), F.lit(shards)).cast("int")


def admitted(load: np.ndarray, wanted: list[tuple[int, int, int, int]], quota: float) -> np.ndarray:
    """The share of each request that is admitted, so that gains are large and no shard's load ends above its quota.

    wanted: (shard, target, gain, documents), added up: a row for each pair of shards and gain. Each shard has a price,
    which rises while more would be there than its quota and falls while less would; a request pays that of its target
    and gets back that of the shard it leaves, so documents of two full shards may change places. A request
    is admitted as far as its gain exceeds what it pays."""
    source, target, gain, n = (np.array(c) for c in zip(*wanted, strict=True))
    price = np.zeros(len(load))
    for turn in range(_PRICE_TURNS):
        share = 1 / (1 + np.exp(np.clip(_SHARPNESS * (price[target] - price[source] - gain), -50, 50)))
        moved = n * share
        over = load + np.bincount(target, moved, len(load)) - np.bincount(source, moved, len(load)) - quota
        price = np.maximum(0, price + 2 * over / max(quota, 1) / (1 + turn / 20))
    return share


def propagate(linked: DataFrame, shards: int, quota: float, rounds: int = ROUNDS) -> DataFrame:
    """(hub, home, shard): where the documents of a hub that start at `home` end.

    linked: (hub, home, n). quota: documents that a shard may hold. Ends when nothing moves, or
    after `rounds` rounds. The driver sees totals by pairs of shards and gain only.
    """
    spark = linked.sparkSession
    state = materialize(linked.withColumn("shard", F.col("home")), "shards")
    full: list[int] = []
    for _ in range(rounds):
        held = state.groupBy("hub", "shard").agg(F.sum("n").alias("m"))
        weight = F.struct("m", F.xxhash64("hub", "shard").alias("tie"), "shard")
        free = ~F.col("shard").isin(*full) if full else F.lit(True)  # a few numbers of shards
        best = held.where(free).groupBy("hub").agg(F.max(weight).alias("top"))
        asked = held.withColumn("own", weight).join(best, "hub").where("own < top")
        gain = F.floor(F.log2(F.col("m") + F.col("top.m"))).cast("int")
        asked = asked.select("hub", "shard", "m", F.col("top.shard").alias("target"), gain.alias("gain"))
        asked = asked.withColumn("draw", F.pmod(F.xxhash64("hub", "shard", "target"), F.lit(1 << 20)).cast("int"))
        asked = materialize(asked, "moves")
        wanted = [tuple(r) for r in asked.groupBy("shard", "target", "gain").agg(F.sum("m").alias("n")).collect()]
        if not wanted and not full:
            break
        if not wanted:
            full = []  # only shards that were full the round before are left to ask for
            continue
        load = np.zeros(shards)
        for r in held.groupBy("shard").agg(F.sum("m").alias("n")).collect():
            load[r["shard"]] = r["n"]
        share = admitted(load, wanted, quota)
        asked_for, let_in = np.zeros(shards), np.zeros(shards)
        below = []
        for (source, target, gain, n), part in zip(wanted, share.tolist(), strict=True):
            asked_for[target] += n
            let_in[target] += n * part
            below.append((source, target, gain, int(part * (1 << 20))))
        full = np.flatnonzero(let_in < asked_for / 2).tolist()
        limits = spark.createDataFrame(below, "shard int, target int, gain int, below int")  # shards^2 rows for each gain at most
        taken = asked.join(F.broadcast(limits), ["shard", "target", "gain"])
        taken = taken.where("draw < below").select("hub", "shard", "target")
        state = state.join(taken, ["hub", "shard"], "left").withColumn("shard", F.coalesce("target", "shard")).drop("target")
        state = materialize(state.select("hub", "home", "n", "shard"), "shards")
    return state.select("hub", "home", "shard")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (of a written table) with `place`, their number from 0 in the given order. Ranges are sorted apart; the driver
    adds up one count per range. Equal rows are divided among ranges by their place in the table."""
    order = [*order, "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.drop("_row").withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", 33).cast("int").alias("part")
    counts = sorted(ranged.groupBy(part).count().collect())
    before, total = [], 0
    for r in counts:
        before.append((r["part"], total))
        total += r["count"]
    first = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, first long"))
    ranged = ranged.withColumn("part", part).join(first, "part")
    return ranged.withColumn("place", F.col("first") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "part", "first")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs` (doc_id, text).

    The law is `rows`: shard sizes in documents differ by one at most, and slots run from 0 in each
    shard. Equal texts are linked. A null text is linked to other nulls, has the size OVERHEAD and
    the checksum 0; an empty text likewise to empty ones. Repeated rows and null doc_ids are rows
    like others; other columns are ignored. grown_shard is null under this law.
    """
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    hub = F.coalesce(F.xxhash64("text", F.octet_length("text")), F.lit(0))
    slim = docs.select("doc_id", (F.length(data).cast("long") + OVERHEAD).alias("size"), F.crc32(data).alias("text_crc32"), hub.alias("hub"))
    slim = materialize(slim.withColumn("home", _home(shards)), "documents")
    linked = slim.groupBy("hub", "home").agg(F.count("*").alias("n"))
    hubs = linked.groupBy("hub").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("hub")
    total = slim.count()
    ends = propagate(linked.join(hubs, "hub"), shards, total / shards, rounds).withColumnRenamed("shard", "lead")
    columns = ["doc_id", "size", "text_crc32", "hub", "lead"]
    led = materialize(slim.join(ends, ["hub", "home"], "left").select(*columns), "leads")
    # Documents without links fill what the linked ones leave of each shard.
    load = {r["lead"]: r["count"] for r in led.where("lead is not null").groupBy("lead").count().collect()}
    begin = [-(-s * total // shards) for s in range(shards + 1)]
    full, filled = 0, []
    for s in range(shards):
        full += max(0, begin[s + 1] - begin[s] - load.get(s, 0))
        filled.append(full)
    bounds = F.array(*(F.lit(x) for x in filled[:-1])).cast("array<long>")
    single = numbered(led.where("lead is null").drop("lead"), ["doc_id", "hub"])
    single = single.withColumn("lead", F.size(F.filter(bounds, lambda x: x <= F.col("place")))).select(*columns)
    ordered = led.where("lead is not null").withColumn("alone", F.lit(0)).unionByName(single.withColumn("alone", F.lit(1)))
    placed = numbered(ordered, ["lead", "alone", "hub", "doc_id"])
    # Places s * total / shards, rounded up, and on belong to shard s.
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards} div {max(total, 1)} as int)"))
    placed = placed.withColumn("slot", F.expr(f"place - (cast(shard as long) * {total} + {shards - 1}) div {shards}"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
