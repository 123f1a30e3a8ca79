"""Shuffles are made fine enough for the input; what is finer already stays."""

import pytest

from tidemark import storage
from tidemark.plans.views import select

CONF = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.fixture
def conf(spark):
    before = {c: spark.conf.get(c) for c in CONF}
    yield spark.conf
    for c, value in before.items():
        spark.conf.set(c, value)


def test_more_partitions_for_more_input(spark, sf_dir, conf, monkeypatch):
    monkeypatch.setattr(storage, "INPUT_BYTES", 1000)
    conf.set(CONF[0], "3")
    conf.set(CONF[1], "64MB")
    select(spark, sf_dir, "SELECT n_name FROM nation")
    few = int(conf.get(CONF[0]))
    rows = select(spark, sf_dir, "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
    assert 3 <= few < int(conf.get(CONF[0])) and conf.get(CONF[1]) == f"{storage.TASK_BYTES}b"
    assert rows.where("n > 0").count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey").distinct().count()


def test_finer_shuffles_stay(spark, sf_dir, conf):
    conf.set(CONF[0], "77")
    conf.set(CONF[1], "16k")
    select(spark, sf_dir, "SELECT n_name FROM nation, lineitem")
    assert (conf.get(CONF[0]), conf.get(CONF[1])) == ("77", "16k")
