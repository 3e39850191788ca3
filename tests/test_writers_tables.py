"""Appending and replacing where there is no table yet, a table, or one that can't be read."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from parcelscope.sources import writers


def test_existing_tables(spark, tmp_path):
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "fact_id string, property_id bigint")
    for path in (tmp_path / "absent", tmp_path / "empty"):
        if path.name == "empty":
            path.mkdir()
        for _ in range(2):
            writers.append_facts(facts, str(path))
        assert sorted(r.fact_id for r in spark.read.parquet(str(path)).collect()) == ["a", "b"]
    other = tmp_path / "other"
    spark.range(3).write.parquet(str(other))
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no table")
    for path in (other, broken):
        with pytest.raises((PySparkException, Py4JJavaError)):
            writers.append_facts(facts, str(path))
        with pytest.raises((PySparkException, Py4JJavaError)):
            writers.replace_results(facts, str(path))
    assert spark.read.parquet(str(other)).columns == ["id"]
