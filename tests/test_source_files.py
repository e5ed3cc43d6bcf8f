"""Files that the source queries write first: cut as the rows lie, rows joined once."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import make_ledger, ts
from spendlens.plans import q_sources, registry
from spendlens.sources import store
from spendlens.sources.bindings import ledger as bind

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_parts(spark):
    """300 transactions in 9 partitions; ids 1 to 4 modulo 97 get dirty."""
    led = make_ledger(spark, [(i, 1 + i % 5, 10.0 + i, ts(days=i % 40)) for i in range(300)])
    led.transactions = led.transactions.repartition(9)
    return led


def test_csv_files_are_as_many_as_the_partitions(spark, many_parts):
    path = f"{q_sources._csv_folder(many_parts)}/transaction_data.csv"
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f")).collect()
    assert len({r.f for r in lines}) == 9
    assert sum(r.value.startswith("id,") for r in lines) == 9 and len(lines) == 309
    kept = q_sources.csv_transactions(many_parts).select("id").collect()
    assert sorted(r.id for r in kept) == [i for i in range(300) if i % 97 not in q_sources._DIRT]


def test_quarantine_counts_the_lines_of_all_files(spark, many_parts):
    got = {r.reason: r.lines for r in q_sources.csv_quarantine(many_parts).collect()}
    assert got == {v: len([i for i in range(300) if i % 97 == k]) for k, v in q_sources._DIRT.items()}
    path = f"{q_sources._csv_folder(many_parts)}/transaction_data.csv"
    # No file holds a fixed share of the lines.
    most = spark.read.text(path).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most < 300 / 4


def test_loads_are_stored_from_rows_joined_once(spark, monkeypatch):
    """Before, each of the three loads made the ledger's joins again."""
    led, plans, save, append = bind(spark, SF, "O"), [], store.save_ledger, store.append_transactions
    on = lambda tx: plans.append(tx._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(store, "save_ledger", lambda x, path: (on(x.transactions), save(x, path))[1])
    monkeypatch.setattr(store, "append_transactions", lambda s, path, tx: (on(tx), append(s, path, tx))[1])
    kept = q_sources._stored(led)
    assert len(plans) == 3 and not [p for p in plans if "Join" in p], plans
    columns = led.transactions.columns
    assert kept.transactions.select(columns).exceptAll(led.transactions).isEmpty()
    assert led.transactions.exceptAll(kept.transactions.select(columns)).isEmpty()
    # The activity before is added in the same pass as a load's rows: one exchange.
    both = store.activity_of(kept.transactions, kept.activity)
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_on_the_cuts_and_without_a_date(spark):
    cut = [dt.datetime.fromisoformat(x) for x in q_sources._CUTS]
    dates = [cut[0] - dt.timedelta(seconds=1), *cut, cut[1] + dt.timedelta(seconds=1)]
    led = make_ledger(spark, [(i, 1, 10.0, d) for i, d in enumerate(dates)])
    led.transactions = led.transactions.unionByName(led.transactions.limit(1).withColumn("date", F.lit(None).cast("timestamp_ntz")))
    assert [sorted(r.id for r in p.collect()) for p in q_sources._by_load(led)] == [[0], [1, 2], [3]]
    late = make_ledger(spark, [(1, 1, 10.0, ts())])
    assert [p.count() for p in q_sources._by_load(late)] == [0, 0, 1]
    assert q_sources._stored(late).activity.count() == 1


@pytest.fixture
def small_partitions(spark, monkeypatch):
    """Few partitions for the session, small ones for the input at hand."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "2",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(registry, "PARTITION_BYTES", 4 << 10)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_the_csv_is_joined_in_partitions_that_grow_with_the_input(spark, small_partitions):
    """Before, the session's number of partitions held whatever the input: two here."""
    path = f"{q_sources._csv_folder(bind(spark, SF, 'O'))}/transaction_data.csv"
    assert spark.read.text(path).select(F.input_file_name()).distinct().count() > 4
    assert spark.conf.get(registry._FIRST_PARTITIONS, None) is None


def test_the_number_of_first_partitions_is_set_back(spark, small_partitions, tmp_path):
    many = spark.range(4000).repartition(3)
    with registry.exchanges_for(many):  # reads no files
        assert spark.conf.get(registry._FIRST_PARTITIONS) == "2"
    many.write.parquet(f"{tmp_path}/a b")
    size = sum(f.stat().st_size for f in (tmp_path / "a b").glob("part-*"))
    spark.conf.set(registry._FIRST_PARTITIONS, "3")
    with pytest.raises(KeyError), registry.exchanges_for(spark.read.parquet(f"{tmp_path}/a b")):
        assert spark.conf.get(registry._FIRST_PARTITIONS) == str(-(-size // (4 << 10)))
        raise KeyError
    assert spark.conf.get(registry._FIRST_PARTITIONS) == "3"
    spark.conf.unset(registry._FIRST_PARTITIONS)


def test_loads_are_stored_in_partitions_that_grow_with_the_input(spark, small_partitions, monkeypatch):
    seen, by_load, append = [], q_sources._by_load, store.append_transactions
    on = lambda: seen.append(int(spark.conf.get(registry._FIRST_PARTITIONS, "2")))
    monkeypatch.setattr(q_sources, "_by_load", lambda led: (on(), by_load(led))[1])
    monkeypatch.setattr(store, "append_transactions", lambda *a: (on(), append(*a))[1])
    led = bind(spark, SF, "N")
    kept = q_sources._stored(led)
    assert len(seen) == 3 and min(seen) > 4 and spark.conf.get(registry._FIRST_PARTITIONS, None) is None
    assert kept.transactions.count() == led.transactions.count()
