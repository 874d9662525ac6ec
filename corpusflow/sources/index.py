"""The vector index: upsert by key into a log-structured store of plain Parquet, an append log for streams.

Layout below the index path:

* `base/run=<r>/bucket=<b>`: rows by a hash bucket of the key, sorted by key, one row for each key;
* `deltas/<r>`: what one put has brought, and `deltas/<r>-documents`: the documents that it replaces;
* `commits/<number>.json`: a snapshot: which run holds each bucket, the deltas on top in their order, how
  far the streams' log is folded in;
* `log/stream=<s>/batch=<n>` (vectors appended by streams) and `batches/<s>/<n>` (the finished ones).

Nothing is ever overwritten; a snapshot counts once its commit file is there. A put writes its own rows
and nothing else; readers merge the deltas in. Folding rewrites the buckets that deltas touch, and is done
once the deltas are many or large, so each row is rewritten a bounded number of times as the index grows.
"""

import json
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusflow.schemas import VECTORS
from corpusflow.session import materialize
from corpusflow.sources.commits import CommitConflict, create_file, file_names, file_system, read_file

# Rows aimed at for each bucket; buckets are doubled until they hold less than twice as many.
BUCKET_ROWS = 1_000_000
# Bytes of a row group of the base, unless the session sets its own: the least that is read for one key.
GROUP_BYTES = 16 << 20
# Deltas are folded when they are this many, or hold this share of the base's rows.
MAX_DELTAS = 16
FOLD_SHARE = 0.5
# Parts of a bucket, which a fold deals its rows by. Bits, by a hash, of the rows that it keeps.
PARTS = 32
KEPT_BITS = 1 << 26


class Delta(NamedTuple):
    """One put: its folder, the snapshot that brought it (its order), rows, and whether it replaces documents."""

    folder: str
    run: int
    rows: int
    replaces: bool


class Commit(NamedTuple):
    """base: bucket to the run that holds it. rows: of the base. folded: per stream, the last batch
    of the log that the snapshot holds."""

    snapshot: int
    buckets: int
    base: dict[int, str]
    rows: int
    deltas: tuple[Delta, ...]
    folded: dict[str, int]


EMPTY = Commit(0, 0, {}, 0, (), {})


def latest(vectors: DataFrame) -> DataFrame:
    """The row of the highest version per key.

    A maximum, so a key put over and over shrinks to one row per task before the shuffle;
    equal versions are decided by the other columns, the same way in every run.
    """
    others = [c for c in vectors.columns if c not in ("key", "version")]
    return (
        vectors.groupBy("key").agg(F.max(F.struct("version", *others)).alias("r"))
        .select(*["key" if c == "key" else f"r.{c}" for c in vectors.columns])
    )


def upsert(current: DataFrame, incoming: DataFrame, replace_document: bool = False) -> DataFrame:
    """The index after putting `incoming` by key.

    The higher version of a key wins, of equal ones the incoming. Keys not put again stay, also
    the tail of a document that became shorter. With `replace_document` the versions of whole
    documents are compared, and only chunks of a document's winning version stay.
    """
    match = "filename" if replace_document else "key"

    def versions(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy(F.col(match).alias("_m")).agg(F.max("version").alias(name))

    put = versions(incoming, "_put")
    if replace_document:
        incoming = incoming.join(put, (F.col(match) == F.col("_m")) & (F.col("version") == F.col("_put")), "left_semi")
    kept = current.join(put, (F.col(match) == F.col("_m")) & (F.col("_put") >= F.col("version")), "left_anti")
    there = versions(current, "_there")
    won = latest(incoming).join(there, (F.col(match) == F.col("_m")) & (F.col("_there") > F.col("version")), "left_anti")
    return kept.select(*current.columns).unionByName(won.select(*current.columns))


# ---------------------------------------------------------------- commits


def commit(spark: SparkSession, path: str, snapshot: Commit) -> int:
    """Write a snapshot's commit file, at its number. An unreadable file of that number is passed
    over (no reader sees it): the next number is taken."""
    text = json.dumps(snapshot._asdict())
    number = snapshot.snapshot
    while True:
        try:
            create_file(spark, f"{path}/commits/{number:012d}.json", text)
            return number
        except CommitConflict:
            if _load(spark, path, number) is not None:
                raise
            number += 1


def _load(spark: SparkSession, path: str, number: int) -> Commit | None:
    try:
        row = json.loads(read_file(spark, f"{path}/commits/{number:012d}.json"))
        deltas = tuple(Delta(*d) for d in row["deltas"])
        return Commit(number, row["buckets"], {int(b): r for b, r in row["base"].items()}, row["rows"], deltas, row["folded"])
    except (ValueError, KeyError, TypeError):
        return None


def current_snapshot(spark: SparkSession, path: str) -> Commit | None:
    """The last committed snapshot: names are listed, one file is read."""
    numbers = sorted((int(n[:-5]) for n in file_names(spark, f"{path}/commits") if n.endswith(".json") and n[:-5].isdigit()), reverse=True)
    return next((c for c in (_load(spark, path, n) for n in numbers) if c is not None), None)


# ---------------------------------------------------------------- reading


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(max(buckets, 1))).cast("int")


def _base(spark: SparkSession, path: str, snapshot: Commit, schema: T.StructType, only: set[int] | None = None) -> DataFrame:
    stored = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
    folders = [f"{path}/base/run={r}/bucket={b}" for b, r in sorted(snapshot.base.items()) if only is None or b in only]
    if not folders:
        return spark.createDataFrame([], stored).drop("run")
    return spark.read.schema(stored).option("basePath", f"{path}/base").parquet(*folders).drop("run")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _deltas(spark: SparkSession, path: str, snapshot: Commit, schema: T.StructType) -> tuple[DataFrame, DataFrame | None]:
    """(rows of all deltas with `_run`, replaced documents as (_file, _put, _by) or None)."""
    rows = [spark.read.schema(schema).parquet(f"{path}/deltas/{d.folder}").withColumn("_run", F.lit(d.run)) for d in snapshot.deltas]
    replaced = [
        spark.read.schema("_file string, _put bigint").parquet(f"{path}/deltas/{d.folder}-documents").withColumn("_by", F.lit(d.run))
        for d in snapshot.deltas
        if d.replaces
    ]
    return _union(rows), _union(replaced) if replaced else None


def read_snapshot(
    spark: SparkSession, path: str, snapshot: Commit | None, schema: T.StructType = VECTORS, only: set[int] | None = None
) -> DataFrame:
    """A snapshot with all metadata, and its `bucket` for pruning; `only`: some buckets of it.

    Of a key's rows the highest version stays, of equal ones the later put's. The base is joined to the
    deltas' keys and never grouped, so it is not shuffled while the deltas are small.
    """
    if snapshot is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
    base = _base(spark, path, snapshot, schema, only)
    if not snapshot.deltas:
        return base
    rows, replaced = _deltas(spark, path, snapshot, schema)
    rows = rows.withColumn("bucket", _bucket(snapshot.buckets))
    if only is not None:
        rows = rows.filter(F.col("bucket").isin(*only) if only else F.lit(False))
    return _merge(base, rows, replaced)


def _merge(base: DataFrame, rows: DataFrame, replaced: DataFrame | None) -> DataFrame:
    """The base with the deltas' `rows` on top; both may be of some keys only."""
    if replaced is not None:
        gone = (F.col("filename") == F.col("_file")) & (F.col("_put") >= F.col("version"))
        rows = rows.join(replaced, gone & (F.col("_by") > F.col("_run")), "left_anti")
        base = base.join(replaced, gone, "left_anti")
    others = [c for c in rows.columns if c not in ("key", "version", "_run")]
    newest = rows.groupBy("key").agg(F.max(F.struct("version", "_run", *others)).alias("r"))
    newest = newest.select(*["key" if c == "key" else f"r.{c}" for c in base.columns])

    def beaten(rows: DataFrame, by: DataFrame, higher: Column) -> DataFrame:
        by = by.select(F.col("key").alias("_key"), F.col("version").alias("_by_version"))
        return rows.join(by, (F.col("key") == F.col("_key")) & higher, "left_anti")

    kept = beaten(base, newest, F.col("_by_version") >= F.col("version"))
    won = beaten(newest, kept, F.col("_by_version") > F.col("version"))
    return kept.unionByName(won)


def find_rows(system, folder: str, keys: list[str], columns: list[str]) -> Iterator[tuple[pa.Table, int]]:
    """(rows, bytes) of every row group of a bucket's files that has some of `keys`, which are sorted. Footers
    tell which groups may have them, their key columns which do; only of these other columns are read."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    wanted = pa.array(keys, pa.string())
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.base_name[0] in "._":
            continue
        with system.open_input_file(info.path) as source:
            file = pq.ParquetFile(source)
            there = [c for c in columns if c in file.schema_arrow.names]
            at = file.schema_arrow.names.index("key")
            for g in range(file.num_row_groups):
                group = file.metadata.row_group(g)
                extent = group.column(at).statistics
                if extent is not None and extent.has_min_max:
                    first = bisect_left(keys, extent.min)
                    if first == len(keys) or keys[first] > extent.max:
                        continue
                has = pc.is_in(file.read_row_group(g, ["key"])["key"], value_set=wanted)
                read = there if pc.any(has).as_py() else ["key"]
                sizes = {group.column(c).path_in_schema.split(".")[0]: 0 for c in range(group.num_columns)}
                for c in range(group.num_columns):
                    sizes[group.column(c).path_in_schema.split(".")[0]] += group.column(c).total_compressed_size
                rows = file.read_row_group(g, there).filter(has) if read is there else None
                yield rows, sum(sizes[c] for c in read)


def read_keys(spark: SparkSession, path: str, snapshot: Commit | None, keys: DataFrame, schema: T.StructType = VECTORS) -> DataFrame:
    """The rows of a snapshot that have one of `keys` (key), which are unique. What is read of the base depends on
    the keys, not on the size of the index: a footer for each file of their buckets, and the row groups that
    have them. schema: at least key, version and filename. Keys that aren't there have no row."""
    if snapshot is None:
        return read_snapshot(spark, path, None, schema)
    folders = {b: f"base/run={r}/bucket={b}" for b, r in snapshot.base.items()}
    stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    arrow, columns = to_arrow_schema(stored), schema.names

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            asked = {}
            for bucket, key in zip(batch["bucket"].to_pylist(), batch["key"].to_pylist()):
                asked.setdefault(bucket, []).append(key)
            for bucket, some in asked.items():
                if bucket not in folders:
                    continue
                for rows, _ in find_rows(system, f"{root}/{folders[bucket]}", sorted(some), columns):
                    if rows is not None:
                        rows = rows.append_column("bucket", pa.array([bucket] * rows.num_rows, pa.int32()))
                        full = [rows[f.name] if f.name in rows.column_names else pa.nulls(rows.num_rows, f.type) for f in arrow]
                        yield from pa.table(full, names=arrow.names).cast(arrow).to_batches(max_chunksize=1000)

    keys = keys.select("key")
    ordered = keys.withColumn("bucket", _bucket(snapshot.buckets)).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    base = ordered.mapInArrow(fetch, stored)
    if not snapshot.deltas:
        return base
    rows, replaced = _deltas(spark, path, snapshot, schema)
    rows = rows.join(keys, "key", "left_semi").withColumn("bucket", _bucket(snapshot.buckets))
    return _merge(materialize(base, "index-rows"), rows, replaced)


def open_index(spark: SparkSession, path: str, schema: T.StructType = VECTORS) -> tuple[DataFrame, Callable[[DataFrame, list[str]], DataFrame]]:
    """(vectors, fetch): the current snapshot, and a function that gives some columns of its rows by key. A search
    that is given both reads texts for its hits only. The store is reached by `pyarrow.fs` to fetch."""
    snapshot = current_snapshot(spark, path)

    def fetch(keys: DataFrame, columns: list[str]) -> DataFrame:
        needed = {"key", "version", "filename", *columns}
        rows = read_keys(spark, path, snapshot, keys, T.StructType([f for f in schema if f.name in needed]))
        return rows.select("key", *columns)

    return read_snapshot(spark, path, snapshot, schema), fetch


def read_index(spark: SparkSession, path: str, schema: T.StructType = VECTORS, where: Column | None = None) -> DataFrame:
    """The current snapshot; `where`: rows of some metadata only, a condition that reaches the scan of the
    base, whose files are sorted by key and have the extent of each column in their footers."""
    rows = read_snapshot(spark, path, current_snapshot(spark, path), schema)
    return rows if where is None else rows.filter(where)


# ---------------------------------------------------------------- writing


def _write_base(vectors: DataFrame, path: str, buckets: int, dealt: bool = False) -> tuple[str, set[int]]:
    """A run of whole buckets: (its name, the buckets that it has). Rebalanced by bucket, unless they are dealt by parts
    of buckets: adaptive execution splits large buckets and merges small ones into files of the advisory partition size."""
    run = uuid.uuid4().hex
    group = vectors.sparkSession.conf.get("parquet.block.size", str(GROUP_BYTES))
    placed = vectors.drop("bucket").withColumn("bucket", _bucket(buckets))
    (
        (placed if dealt else placed.hint("rebalance", "bucket")).sortWithinPartitions("bucket", "key")
        .write.option("parquet.block.size", group).partitionBy("bucket").parquet(f"{path}/base/run={run}")
    )
    names = file_names(vectors.sparkSession, f"{path}/base/run={run}")
    return run, {int(n[7:]) for n in names if n.startswith("bucket=")}


def _rows(spark: SparkSession, path: str, run: str) -> int:
    folder = f"{path}/base/run={run}"
    return spark.read.schema("key string").parquet(folder).count() if any(n.startswith("bucket=") for n in file_names(spark, folder)) else 0


def write_snapshot(
    vectors: DataFrame, path: str, buckets: int = 1, after: Commit | None = None, folded: dict[str, int] | None = None
) -> int:
    """Write a snapshot of unique keys as a whole, to follow `after`; returns its number.

    Raises CommitConflict if another snapshot has followed `after` meanwhile: what it put is not in
    `vectors`."""
    spark, last = vectors.sparkSession, after or EMPTY
    run, held = _write_base(vectors, path, buckets)
    rows = _rows(spark, path, run)
    new = Commit(last.snapshot + 1, buckets, dict.fromkeys(held, run), rows, (), last.folded if folded is None else folded)
    return commit(spark, path, new)


def put(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    replace_document: bool = False,
    buckets: int | None = None,
    schema: T.StructType = VECTORS,
    folded: tuple[dict[str, int], dict[str, int]] | None = None,
) -> int:
    """Put vectors into the index; returns the new snapshot's number.

    Writes one delta, whose size is that of `incoming`. The higher version of a key wins, of equal ones the
    later put. With `replace_document` the versions of whole documents are compared, for which the
    versions of the documents put, and nothing else, are read. If another writer commits first, the
    delta follows that snapshot. `buckets` is for the first fold, else their number comes from the data.
    folded: the log's positions between which `incoming` lies; CommitConflict if others have folded them.
    """
    incoming = incoming.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
    written = None
    while True:
        last = current_snapshot(spark, path) or EMPTY
        if folded and last.folded != folded[0]:
            raise CommitConflict(path)
        if written is None or replace_document:
            written = _write_delta(spark, path, incoming, last if replace_document else None, schema)
        delta = Delta(written[0], last.snapshot + 1, written[1], replace_document)
        if buckets and not last.base and not last.deltas:
            last = last._replace(buckets=buckets)
        new = last._replace(snapshot=delta.run, deltas=(*last.deltas, delta), folded={**last.folded, **(folded[1] if folded else {})})
        try:
            number = commit(spark, path, new)
            break
        except CommitConflict:
            continue
    if len(new.deltas) >= MAX_DELTAS or sum(d.rows for d in new.deltas) > FOLD_SHARE * new.rows:
        fold(spark, path, schema)
    return number


def _write_delta(spark: SparkSession, path: str, incoming: DataFrame, last: Commit | None, schema: T.StructType) -> tuple[str, int]:
    """(folder, rows). last: the snapshot whose documents are to be replaced, if any are."""
    folder = uuid.uuid4().hex
    # Written as it came, so that it is computed once.
    incoming.write.parquet(f"{path}/deltas/{folder}")
    incoming = spark.read.schema(schema).parquet(f"{path}/deltas/{folder}")
    rows = incoming.count()
    if last is not None:
        documents = materialize(incoming.groupBy(F.col("filename").alias("_file")).agg(F.max("version").alias("_put")), "documents")
        there = _present(spark, path, last, schema)
        counting = _counting(incoming.select("filename", "version"), documents, there).count()
        if counting < rows:  # then the rows that count
            folder, rows = uuid.uuid4().hex, counting
            _counting(incoming, documents, there).select(*schema.names).write.parquet(f"{path}/deltas/{folder}")
        documents.write.parquet(f"{path}/deltas/{folder}-documents")
    return folder, rows


_SMALL = ["key", "filename", "version", "_run"]


def _winners(rows: DataFrame, replaced: DataFrame | None) -> DataFrame:
    """Those of `rows` (key, filename, version, _run), of the base (run 0) and of deltas, that `_merge` keeps; of rows of a
    delta that have the same key and version, all."""
    if replaced is not None:
        gone = (F.col("filename") == F.col("_file")) & (F.col("_put") >= F.col("version")) & (F.col("_by") > F.col("_run"))
        rows = rows.join(replaced, gone, "left_anti")
    put, same = F.col("_run") > 0, Window.partitionBy("key")
    rows = rows.withColumn("_newest", F.max(F.when(put, F.struct("version", "_run"))).over(same))
    rows = rows.withColumn("_highest", F.max(F.when(~put, F.col("version"))).over(same))
    newest = F.col("version").eqNullSafe(F.col("_newest.version")) & (F.col("_run") == F.col("_newest._run"))
    beaten = F.when(put, F.col("_highest") > F.col("_newest.version")).otherwise(F.col("_newest.version") >= F.col("version"))
    return rows.filter((~put | newest) & (F.col("key").isNull() | ~F.coalesce(beaten, F.lit(False)))).select(*_SMALL)


def _present(spark: SparkSession, path: str, last: Commit, schema: T.StructType) -> DataFrame:
    """(filename, version) of a snapshot's rows."""
    rows, replaced = _deltas(spark, path, last, schema) if last.deltas else (None, None)
    small = _base(spark, path, last, schema).withColumn("_run", F.lit(0)).select(*_SMALL)
    if rows is not None:
        small = _winners(small.unionByName(rows.select(*_SMALL)), replaced)
    return small.select("filename", "version")


def _counting(rows: DataFrame, documents: DataFrame, there: DataFrame) -> DataFrame:
    """Those of `rows` (filename, version) that have the version put of their document (_file, _put), where `there` has none later."""
    later = there.join(documents, (F.col("filename") == F.col("_file")) & (F.col("version") > F.col("_put")), "left_semi")
    counts = documents.join(later.select(F.col("filename").alias("_later")).distinct(), F.col("_file") == F.col("_later"), "left_anti")
    return rows.join(counts, (F.col("filename") == F.col("_file")) & (F.col("version") == F.col("_put")), "left_semi")


def _kept_rows(rows: DataFrame, won: DataFrame, buckets: int) -> DataFrame:
    """The `rows` that have won, dealt by parts of buckets: the only time that whole rows are shuffled. Of rows of a delta that
    have the same key and version one is kept. A bit for each hash lets few of the rows that haven't won pass on."""
    spark = rows.sparkSession
    place = F.pmod(F.xxhash64(*_SMALL), F.lit(KEPT_BITS))
    words = won.select(place.alias("at")).selectExpr("shiftright(at, 6) as word", "shiftleft(1L, cast(at & 63 as int)) as bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # KEPT_BITS / 64 rows at most
    bits = np.zeros(KEPT_BITS // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def passes(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    marked = rows.filter(passes(place)).withColumn("_won", F.lit(0))
    marked = marked.unionByName(won.withColumn("_won", F.lit(1)), allowMissingColumns=True)
    marked = marked.withColumn("bucket", _bucket(buckets)).withColumn("_part", F.pmod(F.xxhash64(F.lit(PARTS), "key"), F.lit(PARTS)))
    dealt = marked.repartition("bucket", "_part")
    same = ["bucket", "_part", "key", "version", "_run"]
    kept = dealt.withColumn("_has", F.max("_won").over(Window.partitionBy(*same, "filename"))).filter("_won = 0 and _has = 1")
    others = [F.desc(c) for c in rows.columns if c not in ("key", "version", "_run")]
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(*others))).filter("_run = 0 or _n = 1")
    return kept.drop("_won", "_has", "_n", "_part", "_run")


def fold(
    spark: SparkSession,
    path: str,
    schema: T.StructType = VECTORS,
    gained: DataFrame | None = None,
    replace_document: bool = False,
    buckets: int | None = None,
    folded: tuple[dict[str, int], dict[str, int]] | None = None,
) -> int:
    """Merge the deltas into the base: only the buckets that they touch are written again, all of them
    where the index has outgrown their number. Deltas that others put meanwhile stay on top.

    gained, folded: stored rows to be folded as if they had been put, and the log's positions between which they lie;
    CommitConflict if others have folded them. Which rows stay is decided by their small columns."""
    first = buckets
    while True:
        last = current_snapshot(spark, path) or EMPTY
        if first and not last.base and not last.deltas:
            last = last._replace(buckets=first)
        if folded and last.folded != folded[0]:
            raise CommitConflict(path)
        if not last.deltas and gained is None:
            return last.snapshot
        buckets, most = max(last.buckets, 1), last.rows + sum(d.rows for d in last.deltas) + (gained.count() if gained is not None else 0)
        while most >= 2 * BUCKET_ROWS * buckets:
            buckets *= 2
        rows, replaced = _deltas(spark, path, last, schema) if last.deltas else (None, None)
        whole = _base(spark, path, last, schema).drop("bucket").withColumn("_run", F.lit(0))
        before = [whole] if rows is None else [whole, rows]
        small = [r.select(*_SMALL) for r in before]
        if gained is not None:
            run = last.snapshot + 1
            new = gained.select(*schema.names).withColumn("_run", F.lit(run))
            counting = new.select(*_SMALL)
            if replace_document:
                documents = materialize(gained.groupBy(F.col("filename").alias("_file")).agg(F.max("version").alias("_put")), "documents")
                counting = _counting(counting, documents, _present(spark, path, last, schema))
                put_documents = documents.withColumn("_by", F.lit(run))
                replaced = put_documents if replaced is None else replaced.unionByName(put_documents)
            rows = new if rows is None else rows.unionByName(new)
            small.append(counting)
        won = materialize(_winners(_union(small), replaced), "index-winners")
        if buckets == last.buckets:
            found = rows.select(_bucket(buckets).alias("b"))
            if replaced is not None:
                old = _base(spark, path, last, schema).select("bucket", "filename", "version")
                gone = (F.col("filename") == F.col("_file")) & (F.col("_put") >= F.col("version"))
                found = found.union(old.join(replaced, gone, "left_semi").select("bucket"))
            touched = {r.b for r in found.distinct().collect()}
            base = _base(spark, path, last, schema, touched).drop("bucket").withColumn("_run", F.lit(0))
            won = won.filter(_bucket(buckets).isin(*touched) if touched else F.lit(False))
        else:
            touched, base = None, whole
        run, held = _write_base(_kept_rows(base.unionByName(rows), won, buckets), path, buckets, True)
        kept = {} if touched is None else {b: r for b, r in last.base.items() if b not in touched}
        base = kept | dict.fromkeys(held, run)
        total = _base(spark, path, last._replace(base=base), schema).select("key").count()
        while True:
            now = current_snapshot(spark, path) or EMPTY
            if folded and now.folded != folded[0]:
                raise CommitConflict(path)
            if now.base != last.base or now.deltas[: len(last.deltas)] != last.deltas:
                break  # somebody else has folded
            new = now._replace(
                snapshot=now.snapshot + 1, buckets=buckets, base=base, rows=total, deltas=now.deltas[len(last.deltas) :],
                folded={**now.folded, **(folded[1] if folded else {})},
            )
            try:
                return commit(spark, path, new)
            except CommitConflict:
                continue


# ---------------------------------------------------------------- the streams' log


def read_if_there(reader: Callable[[str], DataFrame], path: str) -> DataFrame | None:
    try:
        return reader(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_log(batch: DataFrame, path: str, stream: str, number: int) -> None:
    """Add one batch of a stream to the log; a batch that runs again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/log/stream={stream}/batch={number}")
    system, done = file_system(batch.sparkSession, f"{path}/batches/{stream}/{number}")
    system.create(done, True).close()


def log_end(spark: SparkSession, path: str) -> dict[str, int]:
    """The last finished batch of each stream: names of empty files, no data is read."""
    ends = {s: [int(n) for n in file_names(spark, f"{path}/batches/{s}") if n.isdigit()] for s in file_names(spark, f"{path}/batches")}
    return {s: max(done) for s, done in ends.items() if done}


def read_log(
    spark: SparkSession, path: str, after: dict[str, int], upto: dict[str, int], schema: T.StructType = VECTORS
) -> DataFrame:
    """The log's batches after one position up to another, by partition filters."""
    stored = T.StructType([*schema.fields, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
    log = read_if_there(spark.read.schema(stored).parquet, f"{path}/log") if upto else None
    if log is None:
        return spark.createDataFrame([], schema)
    wanted = F.lit(False)
    for stream, last in upto.items():
        wanted |= (F.col("stream") == stream) & (F.col("batch") > after.get(stream, -1)) & (F.col("batch") <= last)
    return log.filter(wanted).select(*schema.names)


def compact(spark: SparkSession, path: str, replace_document: bool = False, buckets: int | None = None) -> int:
    """Put what the log has gained since the last snapshot, as one delta; a gain that would be folded at once is folded
    from the log.

    The commit records how far the log is folded, so no batch is folded twice and an older
    version in the log never comes back. With nothing to fold, no snapshot is written.
    """
    while True:
        last = current_snapshot(spark, path) or EMPTY
        upto = log_end(spark, path)
        if last.snapshot and all(last.folded.get(s, -1) >= n for s, n in upto.items()):
            return last.snapshot
        gained = read_log(spark, path, last.folded, upto)
        rows = gained.count() + sum(d.rows for d in last.deltas)
        try:
            if len(last.deltas) + 1 >= MAX_DELTAS or rows > FOLD_SHARE * last.rows:
                return fold(spark, path, VECTORS, gained, replace_document, buckets, (last.folded, upto))
            return put(spark, path, gained, replace_document, buckets, folded=(last.folded, upto))
        except CommitConflict:
            continue
