"""The derived inputs follow the tables: any number of species keeps every
request, every stage is asked for, file order survives several files."""

import pytest
from pyspark.sql import functions as F

from rationflow.sources import files as FS
from rationflow.sources import testdata as td
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("n", [1, 5, 7])
def test_every_request_has_a_species(spark, tmp_path, n):
    d = str(tmp_path)
    part = td.table(spark, SF_SMALL, "part").withColumn("p_type", F.concat(F.lit("T"), (F.col("p_partkey") % n).cast("string")))
    part.write.parquet(f"{d}/part.parquet")
    td.table(spark, SF_SMALL, "orders").write.parquet(f"{d}/orders.parquet")
    s = td.scenarios(spark, d)
    assert s.count() == td.table(spark, SF_SMALL, "orders").count()
    assert s.select("species").distinct().count() == n and s.where("species is null").count() == 0


def test_every_stage_is_asked_for(spark):
    from rationflow.plans import queries as Q
    stages = {r.stage for r in Q.q_standards_union(spark, SF_SMALL).select("stage").distinct().collect()}
    assert len(stages) == 19 and "Beef Finisher" in stages


def test_file_position_over_several_blocks(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    with open(path, "w") as f:
        f.write("Ingredient,CP,Energy,Fiber,Cost\n" + "".join(f"i{i},1,2,3,{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = FS.read_catalog_csv(spark, path, "S").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.pos, r.cost) for r in rows) == [(i + 1, float(i)) for i in range(5000)]


def test_first_per_key_has_no_sort_over_raw_rows(spark):
    from rationflow.operators.catalog import first_per_key
    df = first_per_key(td.listing(spark, SF_SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("LeftSemi"):]  # what runs over the raw rows
    assert "SortAggregate" not in below and "HashAggregate" in below
    ties = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, 2, "z"), (None, 1, "w")], "k string, pos int, v string")
    got = {r.k: r.v for r in first_per_key(ties, ["k"]).collect()}
    assert got[None] == "w" and got["a"] in ("x", "y") and len(got) == 2
