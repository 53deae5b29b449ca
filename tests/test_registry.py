"""Every query with SQL gives DuckDB's rows on the small tables."""

import duckdb
import pytest

from lumenflow.plans import media_files, metadata, registry, tracks  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, columns):
    text = lambda v: None if v is None else f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted((tuple(text(v) for v in r) for r in zip(*columns, strict=True)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DIR).toArrow()
    want = c.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    assert rows(names, [got.column(n).to_pylist() for n in names]) == rows(names, [want.column(n).to_pylist() for n in names])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1000
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bounds_of_large_ids(spark, tmp_path):
    """The ids of larger tables: 500 times sf0.01's and beyond, of both signs."""
    ids = [0, 4_999, 5_000, 505_000, 505_001, 600_000, 6_000_000, -600_000, 1 << 40, -(1 << 40)]
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(registry.ORACLE_SQL["rescale_bounds"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["rescale_bounds"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(ids)


def test_partitions_of_samples_grow_with_rows(spark, monkeypatch):
    """A task's windows hold so many rows, however many there are."""
    monkeypatch.setattr(tracks, "TASK_ROWS", 100)
    n = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert tracks._samples(spark, DIR).rdd.getNumPartitions() == -(-n // 100) > 50
    assert registry.QUERIES["mp4_chunking"](spark, DIR).rdd.getNumPartitions() == -(-n // 100)
