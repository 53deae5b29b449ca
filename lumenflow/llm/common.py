"""What the corpus operators share: the cluster's shared folder, tables that cut lineage, code for the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup side whose groups hold at least this share of all rows has at most 1 / share rows.
HOT_SHARE = 1 / 1000

#: Bytes of a row group that a writer holds.
BLOCK_BYTES = 16 << 20
#: Ids that may be broadcast: 8 bytes each, a few times that as a hash table.
BROADCAST_IDS = 250_000
#: Bytes of long lookup rows that may be broadcast: the driver holds them several times over.
BROADCAST_BYTES = 8 << 20
#: Rows of an id and a hash that may be broadcast: about 150 bytes each in the driver's hash table, so as many as ``BROADCAST_BYTES`` hold.
BROADCAST_MARKS = 50_000
#: Rows that share one copy of a lookup row where those are too long to be broadcast.
COPY_ROWS = 64
#: Bytes of a file that Spark may broadcast unasked. It goes by the size of the file, which says little of the
#: rows: a few columns of it exploded into 64 rows each are a hundred times what Spark expects.
FILE_BROADCAST = "64k"
#: Bytes of rows, as counted when they were shuffled, that Spark may broadcast unasked.
ROWS_BROADCAST = "1m"
#: Rows of an Arrow batch: some megabytes of texts.
BATCH_ROWS = 1000

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is unset (a single machine, as in tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        known = f"file://{tempfile.mkdtemp(prefix='lumenflow-')}"
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/lumenflow/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor costs nothing before it."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application; keep Arrow batches of long texts, and what Spark broadcasts unasked, small."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if not spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):  # -1: broadcasts are off
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", FILE_BROADCAST)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", ROWS_BROADCAST)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="lumenflow-code-"), "lumenflow_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def quoted(column: str) -> str:
    """A column's name as it is, dots and all."""
    return "`" + column.replace("`", "``") + "`"


def lookup_by_group(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str) -> DataFrame:
    """``rows`` left-joined with ``groups`` on ``keys`` (null-safe callers fill nulls first), without a hot task.

    ``groups`` has one row for each key; ``size_col`` says how many of ``rows`` have it. Groups
    that hold at least ``HOT_SHARE`` of all rows number at most ``1 / HOT_SHARE``, so that part is
    broadcast by a proven bound; the rest has no large group and is joined by shuffle. Both inputs
    should be settled tables, as they are read twice.
    """
    extra = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(size_col).alias("n")).first()["n"] or 0
    least = max(2.0, total * HOT_SHARE)
    hot = groups.filter(F.col(size_col) >= least).withColumn("_hot", F.lit(True))
    cold = groups.filter(F.col(size_col) < least)
    tried = rows.join(F.broadcast(hot), keys, "left")
    found = tried.filter(F.col("_hot")).drop("_hot")
    rest = tried.filter(F.col("_hot").isNull()).drop("_hot", *extra).join(cold, keys, "left")
    return found.unionByName(rest.select(*found.columns))


def lookup_long_by_group(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, bytes_of: Column, spread: Column) -> DataFrame:
    """:func:`lookup_by_group` for ``groups`` whose rows are long: ``bytes_of`` is what each holds.

    Hot groups of more than ``BROADCAST_BYTES`` in all are not broadcast, only their sizes are. Each
    group is copied once for every ``COPY_ROWS`` of its rows, the rows are dealt over the copies by
    ``spread``, and the join by shuffle has no hot task.
    """
    sums = groups.agg(F.sum(size_col).alias("n"), F.sum(bytes_of).alias("bytes")).first()
    if (sums["bytes"] or 0) > BROADCAST_BYTES:
        hot = groups.filter(F.col(size_col) >= max(2.0, sums["n"] * HOT_SHARE)).agg(F.sum(bytes_of).alias("bytes")).first()
        if (hot["bytes"] or 0) > BROADCAST_BYTES:
            copies = F.ceil(F.col(size_col) / F.lit(COPY_ROWS)).cast("long")
            counted = lookup_by_group(rows, groups.select(*keys, size_col, copies.alias("_copies")), keys, size_col).drop(size_col)
            dealt = counted.withColumn("_copy", F.pmod(spread, F.col("_copies"))).drop("_copies")
            copied = groups.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
            return dealt.join(copied.hint("merge"), [*keys, "_copy"], "left").drop("_copy")
    return lookup_by_group(rows, groups, keys, size_col)


def rows_with_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The ``rows`` whose id is in ``ids`` (a settled table): ids are broadcast if they are few enough, joined by shuffle else."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, id_col, "left_semi")


def marks(rows: DataFrame) -> DataFrame:
    """``rows`` of an id and a hash (a settled table) for the right side of a join: broadcast if they are few enough, joined by shuffle else."""
    few = rows.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS
    return F.broadcast(rows) if few else rows
