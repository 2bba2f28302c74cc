from larder.operators.quality import orphans


def test_parents_are_not_broadcast(spark, tmp_path):
    parent = spark.range(0, 20_000, 2).toDF("id")
    parent.unionByName(parent.filter("id < 10")).write.parquet(str(tmp_path / "parent"))
    child = spark.range(0, 100).selectExpr("case when id % 10 < 9 then id div 2 end as fk").unionByName(spark.range(30_001, 30_002).toDF("fk"))
    found = orphans(child, spark.read.parquet(str(tmp_path / "parent")), "fk", "id", "c")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    keys = {k // 2 for k in range(100) if k % 10 < 9}
    assert sorted(r.key for r in found.collect() if r.key is not None) == sorted(map(str, {k for k in keys if k % 2} | {30_001}))
    assert [r.key for r in found.collect()].count(None) == 1
