"""Queries over keys that are larger than those of the given tables."""

import pytest
from pyspark.sql import functions as F
from tests.oracle import spark_rows, sql_rows

from acrelight.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    """The tables with every customer also under keys from 10^4 to 10^9."""
    sf_dir = tmp_path_factory.mktemp("larger")
    customer = spark.read.parquet(f"{SF}/customer.parquet")
    shifted = customer.withColumn("shift", F.explode(F.array(*(F.lit(n) for n in (0, 9_990, 12_340, 10**6, 10**9)))))
    shifted.withColumn("c_custkey", F.col("c_custkey") + F.col("shift")).drop("shift").write.parquet(f"{sf_dir}/customer.parquet")
    for name in "region nation supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        (sf_dir / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    return str(sf_dir)


@pytest.mark.parametrize("name", ["resolve_mappings"])
def test_query_matches_sql_on_larger_keys(spark, larger, name):
    assert spark_rows(registry.queries()[name](spark, larger)) == sql_rows(registry.oracle_sql()[name], larger)
