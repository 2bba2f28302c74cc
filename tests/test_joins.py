import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.plans.joins import dense_ids, fits_broadcast, group_ordinals, join_dimension, split_join, spread


@pytest.fixture(scope="module")
def fact(spark):
    # One key holds a third of all rows; some keys and a null key have no dimension row.
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).cast("int").alias("k"),
        F.col("id").alias("v"),
    )


@pytest.fixture(scope="module")
def dimension(spark):
    return spark.range(30).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(fact, dimension, how):
    want = sorted(map(str, fact.join(dimension, "k", how).collect()))
    for bounds in ({}, {"hot_rows": 70}, {"hot_rows": 70, "hot_keys": 1}, {"hot_rows": 1}):
        assert sorted(map(str, split_join(fact, dimension, ["k"], how, **bounds).collect())) == want
    assert sorted(map(str, join_dimension(fact, dimension, "k", how, max_broadcast_rows=3).collect())) == want
    assert sorted(map(str, join_dimension(fact, dimension, "k", how).collect())) == want


def test_large_dimension_is_not_broadcast_and_nothing_is_repeated(fact, dimension):
    plan = join_dimension(fact, dimension, "k", "left", max_broadcast_rows=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower() and "Generate" not in plan
    # of the dimension only the rows of hot keys are broadcast
    assert plan.count("strategy=broadcast") >= 2 and "Join LeftSemi" in plan


def test_equal_rows_of_a_hot_key_are_not_shuffled(spark, dimension):
    # two thirds of all rows are one row, and a sixth has no key
    rows = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 6 < 4, 7).when(F.col("id") % 6 == 4, F.lit(None)).otherwise(F.col("id") % 29).cast("int").alias("k"), F.lit("same").alias("v")
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = split_join(rows, dimension, ["k"], "left", hot_rows=5_000)
        sizes = joined.select("k", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        by_key = {r.k: (r["count"], r.names) for r in joined.groupBy("k").agg(F.count("*").alias("count"), F.collect_set("name").alias("names")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the hot rows stay where they were read: six tasks of about the same size
    assert max(r["count"] for r in sizes) < 60_000 / 6 and by_key[7][0] >= 40_000 and by_key[7][1] == ["n7"] and by_key[None] == (10_000, [])


def test_broadcasts_are_bounded_by_bytes(spark):
    narrow = spark.range(100)
    wide = narrow.select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit("y" * 100)).alias("parts"))
    assert fits_broadcast(narrow, 100, 10_000) and not fits_broadcast(narrow, 99)
    assert not fits_broadcast(wide, 100, 100_000) and fits_broadcast(wide, 100, 200_000) and fits_broadcast(wide.limit(0), 0, 0)


def test_group_ordinals_of_a_hot_group(fact):
    got = {r.v: r.ordinal for r in group_ordinals(fact, ["k"], [F.col("v").desc()]).collect()}
    window = Window.partitionBy("k").orderBy(F.col("v").desc())
    want = {r.v: r.n for r in fact.withColumn("n", F.row_number().over(window)).collect()}
    assert got == want


def test_dense_ids(fact):
    got = [(r.v, r.id) for r in dense_ids(fact, [F.col("v").desc()], 11).collect()]
    assert sorted(got) == [(2999 - i, 11 + i) for i in reversed(range(3000))]
    assert dense_ids(fact.filter("v < 0"), [F.col("v")], 5).count() == 0


def test_spread(spark):
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 4
    assert spread(spark.range(0, 100, 1, 9)).rdd.getNumPartitions() == 9


def test_texts_that_repeat_are_computed_once(spark):
    from larder.functions.lines import parse_lines
    from larder.operators.resolve import parse_texts
    from larder.plans.joins import lookup_distinct

    rows = [(k, ["2 EL Mehl, fein", "Salz", None, " ", "evtl. 1 Prise Zucker"][k % 5]) for k in range(400)]
    lines = spark.createDataFrame(rows, "id int, raw_text string").cache()
    seen = []

    def compute(texts):
        seen.append(texts.count())
        return parse_lines(texts)

    once = lookup_distinct(lines, "raw_text", compute)
    assert seen == [4] and once.columns == parse_lines(lines).columns
    assert sorted(map(str, parse_texts(lines).collect())) == sorted(map(str, parse_lines(lines).collect()))
    few = lines.filter("id < 5")
    assert sorted(map(str, parse_texts(few).collect())) == sorted(map(str, parse_lines(few).collect()))


def test_each_of_several_texts_is_computed_once(spark):
    from larder.plans.joins import lookup_each

    lines = spark.createDataFrame([(k, "ab"[k % 2], f"t{k}", None) for k in range(40)] + [(40, None, "t0", "x")], "id int, one string, two string, three string")
    asked = []

    def length(text, name):
        def compute(texts):
            asked.append((text, texts.columns))
            return texts.withColumn(name, F.length(text))

        return compute

    found = lookup_each(lines, {c: length(c, f"n_{c}") for c in ("one", "two", "three")})
    assert found.columns == ["id", "one", "two", "three", "n_one", "n_two", "n_three"]
    assert {r.id: (r.n_one, r.n_two, r.n_three) for r in found.collect()} == {k: (None if k == 40 else 1, len(f"t{k % 40}"), 1 if k == 40 else None) for k in range(41)}
    assert ("one", ["one"]) in asked and asked[0][0] == "one" and len(asked[0][1]) == 1
