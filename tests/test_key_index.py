import random

import pytest
from pyspark.sql import functions as F

from larder.streaming.key_index import KeyIndex, bucket_of, live_folders


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_live_folders_hold_each_batch_once(fan):
    for batch in range(200):
        covered = [b for level, n in live_folders(batch, fan) for b in range(n * fan**level, (n + 1) * fan**level)]
        assert sorted(covered) == list(range(batch))
        levels = 1
        while fan**levels <= batch:
            levels += 1
        assert len(live_folders(batch, fan)) <= (fan - 1) * levels


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def test_fifty_batches(spark, tmp_path):
    index, rng, stored = KeyIndex(spark, str(tmp_path / "keys"), buckets=4, fan=4), random.Random(1), set()
    for batch in range(50):
        new = {f"https://example.org/{rng.randrange(120)}" for _ in range(3)}
        if batch % 12 == 0:
            index.add(keys(spark, "left behind by a broken attempt", *new), batch)
        index.add(keys(spark, None, *new), batch)
        stored |= new
        if batch % 7 == 6 or batch == 49:
            asked = keys(spark, "https://example.org/5", "https://example.org/77")
            near = index.near(asked, batch + 1)
            buckets = {r.b for r in asked.select(bucket_of("key", 4).alias("b")).collect()}
            files = {r.f for r in near.select(F.input_file_name().alias("f")).distinct().collect()}
            # one file per folder that counts and bucket that is touched, however many batches there were
            assert len(files) <= len(live_folders(batch + 1, 4)) * len(buckets) <= 9 * 2
            want = {k for k in stored if keys(spark, k).select(bucket_of("key", 4)).first()[0] in buckets} if batch == 49 else None
            if want is not None:
                assert {r.key for r in near.collect()} == want


def test_a_batch_does_not_see_its_own_earlier_attempt(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), fan=2)
    for batch, key in enumerate(["a", "b", "c", "d"]):
        index.add(keys(spark, key), batch)
    every = keys(spark, "a", "b", "c", "d")
    assert sorted(r.key for r in index.near(every, 3).collect()) == ["a", "b", "c"]
    # the third runs again with other rows, and the folder that holds it is built anew by the fourth
    index.add(keys(spark, "c2"), 2)
    index.add(keys(spark, "d"), 3)
    assert sorted(r.key for r in index.near(keys(spark, "a", "b", "c", "c2", "d"), 4).collect()) == ["a", "b", "c2", "d"]


def test_no_keys(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"))
    assert index.near(keys(spark, "a"), 0).count() == 0
    index.add(keys(spark), 0)
    index.add(keys(spark, "b"), 1)
    assert [r.key for r in index.near(keys(spark, "b"), 2).collect()] == ["b"] and index.near(keys(spark), 2).count() == 0
