"""Tables with snapshots: transactions, conflicts, compaction and replicas."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.sources.tables import Conflict, Table
from rowmill.streaming import replicas

SCHEMA = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("v", T.IntegerType())])


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", SCHEMA)
    t.insert(spark.createDataFrame([(i, 10 * i) for i in range(1, 11)], "id int, v int"))
    return t


def values(df):
    return sorted((r.id, r.v) for r in df.collect())


def test_update_and_delete(table):
    assert table.update({"v": F.lit(0)}, F.col("id") <= 2) == 2
    table.delete(F.col("id") > 3)
    assert values(table.read()) == [(1, 0), (2, 0), (3, 30)]
    assert values(table.read(1)) == [(i, 10 * i) for i in range(1, 11)]


def test_update_of_updated_rows(table):
    for k in range(3):
        table.update({"v": F.col("v") + 1}, F.col("id") == 1)
    assert (1, 13) in values(table.read()) and table.read().count() == 10


def test_snapshots_and_first_updater_wins(table):
    first, second = table.begin(), table.begin()
    first.update({"v": F.lit(777)}, F.col("id") == 1)
    assert (1, 777) in values(first.read()) and (1, 10) in values(second.read())
    second.delete(F.col("id") == 1)
    first.commit()
    assert (1, 10) not in values(table.read())
    with pytest.raises(Conflict):
        second.commit()
    assert (1, 777) in values(table.read())


def test_readers_never_conflict(table):
    reader = table.begin()
    table.delete()
    assert reader.read().count() == 10 and reader.commit() == 1 and table.read().count() == 0


def test_rollback_and_errors(spark, table):
    with pytest.raises(ZeroDivisionError):
        with table.begin() as t:
            t.delete()
            raise ZeroDivisionError
    assert table.read().count() == 10
    with pytest.raises(ValueError):
        t.read()
    with pytest.raises(ValueError):
        table.insert(spark.sql("SELECT 1"))
    with pytest.raises(ValueError):
        table.insert(spark.sql("SELECT 'x', 2"))
    with pytest.raises(ValueError):
        table.update({"w": F.lit(1)})
    with pytest.raises(Exception, match="id is null"):
        table.insert(spark.sql("SELECT cast(null as int), 2"))
    assert table.version() == 1 and table.read().count() == 10


def test_vacuum(spark, table):
    table.delete(F.col("id") % 2 == 0)
    want = values(table.read())
    assert len(table.vacuum()) == 2
    assert values(table.read()) == want
    assert len(table.vacuum()) == 1 and values(table.read()) == want
    assert values(Table(spark, table.path).read()) == want


def test_vacuum_keeps_what_open_transactions_read(table):
    reader = table.begin()
    table.delete(F.col("id") > 5)
    table.vacuum()
    assert reader.read().count() == 10 and table.read().count() == 5
    reader.commit()
    assert table.vacuum() and table.read().count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        table.read(1).count()


def test_vacuum_keeps_recent_versions(table):
    table.delete(F.col("id") > 5)
    assert table.vacuum(keep_seconds=3600) == [] and table.read(1).count() == 10
    assert len(table.vacuum()) > 0


def test_commits_are_whole(spark, table, tmp_path):
    # a crash before the commit's file has its name leaves a draft, which is no commit
    (tmp_path / "t/drafts").mkdir(exist_ok=True)
    (tmp_path / "t/drafts/left").write_text('{"add": [')
    begun = table.begin()
    table.insert(spark.createDataFrame([(11, 0)], "id int, v int"))
    assert table.version() == 2 and begun.read().count() == 10 and table.read().count() == 11
    # what another tool has torn is an error, not another version
    (tmp_path / "t/log/3.json").write_text("")
    with pytest.raises(ValueError, match="torn"):
        table.read()
    assert table.read(1).count() == 10
    with pytest.raises(Conflict):
        t = table.begin()
        t.snapshot = 2
        t.delete()
        t.commit()
    (tmp_path / "t/log/3.json").unlink()
    (tmp_path / "t/log/1.json").unlink()
    with pytest.raises(ValueError, match="missing"):
        table.read()


def test_log_checkpoints(table, monkeypatch):
    from rowmill.sources import tables

    monkeypatch.setattr(tables, "CHECKPOINT", 3)
    for i in range(1, 8):
        table.delete(F.col("id") == i)
    assert sorted(i for i, _ in values(table.read())) == [8, 9, 10]
    assert [n for n, e in enumerate(table.log()) if "all" in e] == [3, 6]
    assert sorted(i for i, _ in values(table.read(4))) == [4, 5, 6, 7, 8, 9, 10]
    assert len(table.vacuum()) == 8 and table.read().count() == 3


def test_statistics_are_kept(spark, table):
    assert table.analyzed() is None
    table.analyze()
    table.delete()
    assert Table(spark, table.path).analyzed().first().rows == 10


def test_replica_begins_after_a_vacuum(spark, table, tmp_path):
    table.delete(F.col("id") > 5)
    table.vacuum()
    table.update({"v": F.lit(1)}, F.col("id") == 1)
    copy = Table(spark, f"file://{tmp_path}/copy", SCHEMA)
    replicas.follow(table, copy, f"{tmp_path}/check").awaitTermination()
    assert values(copy.read()) == values(table.read()) and replicas.lag(table, copy) == 0
    with pytest.raises(ValueError, match="vacuumed"):
        copy.read(1)


def test_table_exists(spark, table):
    with pytest.raises(ValueError):
        Table(spark, table.path, SCHEMA)


def test_statistics(table):
    assert table.statistics().first().asDict() == {"rows": 10, "min_id": 1, "max_id": 10, "min_v": 10, "max_v": 100}


def test_replica(spark, table, tmp_path):
    copy = Table(spark, f"file://{tmp_path}/copy", SCHEMA)
    for change in (lambda: None, lambda: table.update({"v": F.lit(5)}, F.col("id") == 5), table.vacuum, lambda: table.delete(F.col("id") == 1)):
        change()
        replicas.follow(table, copy, f"{tmp_path}/check").awaitTermination()
        assert values(copy.read()) == values(table.read()) and replicas.lag(table, copy) == 0
    # a repeated batch changes nothing
    replicas.follow(table, copy, f"{tmp_path}/other").awaitTermination()
    assert values(copy.read()) == values(table.read()) and copy.version() == table.version()
