import random
from datetime import date, datetime

import pytest

from pyspark.errors import ParseException

from larder.errors import QueryError
from larder.operators import recommend as R
from larder.operators import search as S
from larder.operators import trends as T


@pytest.mark.parametrize("sql", [
    "SELECT 1", "with x as (select 1 a) select * from x", "select 'drop table x' as t", "select 1 -- delete", "(select 1);",
    "select `limit` from etl_runs", "select updated_at from recipes",
])
def test_query_accepted(spark, sql):
    assert S.check_query(sql)


@pytest.mark.parametrize("sql", [
    "", "  ", "DROP TABLE recipes", "select 1; delete from x", "insert into x values (1)", "SELECT * FROM read_parquet('x')",
    "select * from parquet.`/etc/x`", "describe recipes", "SELECT 1 /* c */ UNION TRUNCATE x", "set x = 1",
])
def test_query_refused(spark, sql):
    with pytest.raises(QueryError):
        S.check_query(sql)


def test_run_query_binds_and_limits(spark):
    spark.range(50).createOrReplaceTempView("numbers")
    rows = S.run_query(spark, "select id from numbers where id >= ? order by id", params=[10], limit=3).collect()
    assert [r.id for r in rows] == [10, 11, 12]
    assert S.run_query(spark, "select id as `limit` from numbers", limit=7).count() == 7


RECIPES = "id int, title string, title_normalised string, language string, total_minutes int, difficulty string, course string, starred boolean, status string, owner_rating int, times_cooked int, last_cooked_at timestamp_ntz"  # noqa: E501


def test_find_recipes(spark):
    rows = [
        (1, "Crème brûlée", "creme brulee", "de", 30, "easy", "dessert", True, "active", 5, 1, None),
        (2, "Creme", "creme", "fr", 40, "easy", "dessert", False, "deleted", 3, 0, None),
        (3, "Rösti", "rosti", "de", 50, "medium", "main", True, "active", None, 0, None),
    ]
    recipes = spark.createDataFrame(rows, RECIPES)
    tags = spark.createDataFrame([(1, "für-gäste", "x", "f"), (2, "vegan", "x", "f")], "id int, key string, display string, facet string")
    links = spark.createDataFrame([(1, 1), (1, 2), (3, 2), (1, 2)], "recipe_id int, tag_id int")

    def ids(**kw):
        return [r.id for r in S.find_recipes(recipes, tag_table=tags, recipe_tags=links, **kw).collect()]

    assert ids(query="CRÈME") == [2, 1]
    assert ids(query="CRÈME", include_inactive=False) == [1]
    assert ids(query="100%") == []
    assert ids(tags=["Für Gäste", "vegan", "vegan"]) == [1]
    assert ids(tags=["vegan"]) == [1, 3]
    assert ids(without_tags=["vegan"]) == [2]
    assert ids(starred_only=True, max_total_minutes=45) == [1]
    assert [r.id for r in S.search_recipes(recipes, query="CREME").collect()] == [2, 1]


def brute_coverage(recipes, lines, keys, stocked, extras, missing_ok, limit):
    at_hand = {keys[i] for i in stocked if i in keys} | set(extras) | set(R.V.PANTRY_STAPLES)
    found = []
    for rid, (status, _) in recipes.items():
        parts = [(seq, keys.get(i) or (raw or "").lower()) for r, seq, i, raw in lines if r == rid]
        parts = [p for p in sorted(parts) if p[1]]
        missing = [k for _, k in parts if k not in at_hand]
        if status != "active" or not parts or len(missing) > missing_ok:
            continue
        share = round((len(parts) - len(missing)) / len(parts), 3)
        found.append((-round(share - 0.1 * len(missing), 3), rid, len(parts), missing))
    return [(rid, n, missing) for _, rid, n, missing in sorted(found)[:limit]]


def test_pantry_coverage_against_brute_force(spark):
    rng = random.Random(3)
    keys = {i: f"key-{i}" for i in range(1, 30)} | {30: "salt", 31: "butter"}
    recipes = {r: (rng.choice(["active", "active", "deleted"]), r * 3) for r in range(1, 60)}
    # Recipe 7 owns a third of all lines.
    lines = [
        (7 if rng.random() < 0.33 else rng.randrange(1, 62), seq, rng.choice([None, *keys]), rng.choice([None, "Salz", "Extra", ""]))
        for seq in range(400)
    ]
    stocked = rng.sample(sorted(keys), 18) + [99]
    got = R.suggest_for_pantry(
        spark.createDataFrame([(r, f"t{r}", s, m) for r, (s, m) in recipes.items()], "id int, title string, status string, total_minutes int"),
        spark.createDataFrame(lines, "recipe_id int, seq int, ingredient_id int, raw_text string"),
        spark.createDataFrame(list(keys.items()), "id int, key string"),
        spark.createDataFrame([(i,) for i in stocked], "ingredient_id int"),
        extras=["extra"], missing_ok=3, limit=10,
    ).collect()
    want = brute_coverage(recipes, lines, keys, stocked, ["extra"], 3, 10)
    assert [(r.id, r.ingredient_count, r.missing_ingredients) for r in got] == want


def test_coverage_of_all_recipes_shuffles_few_lines_of_a_hot_one(spark):
    keys = {i: f"key-{i}" for i in range(1, 6)}
    # Recipe 1 has a third of all lines, all missing; recipe 2 as many, with two missing ones, and equal rows.
    lines = [(1, s, 1, None) for s in range(3000)] + [(2, s, 3 if s in (5, 2999) else 2, None) for s in range(3000)]
    lines += [(r, s, 2 + (r + s) % 3, "x") for r in range(3, 1003) for s in range(3)] + [(2000, 1, 2, None)] * 50
    recipes = {r: ("active", 5) for r in [*range(1, 1003), 2000]}
    frames = (
        spark.createDataFrame([(r, f"t{r}", s, m) for r, (s, m) in recipes.items()], "id int, title string, status string, total_minutes int"),
        spark.createDataFrame(lines, "recipe_id int, seq int, ingredient_id int, raw_text string"),
        spark.createDataFrame(list(keys.items()), "id int, key string"),
        spark.createDataFrame([(2,)], "ingredient_id int"),
    )
    for missing_ok in (0, 2):
        got = R.suggest_for_pantry(*frames, missing_ok=missing_ok, limit=None)
        want = brute_coverage(recipes, lines, keys, [2], [], missing_ok, None)
        assert [(r.id, r.ingredient_count, r.missing_ingredients) for r in got.collect()] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan[plan.index("WindowGroupLimit") :]


def test_rotation_and_easy_order(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, "old favourite", "", "de", 20, "easy", "main", True, "active", 5, 3, datetime(2023, 1, 1)),
        (2, "recent favourite", "", "de", 20, "easy", "main", True, "active", 5, 3, datetime(2023, 12, 20)),
        (3, "never", "", "de", 0, None, "main", True, "active", 4, 0, None),
        (4, "low", "", "de", 10, "easy", "main", True, "active", 2, 0, None),
        (5, "gone", "", "de", 10, "easy", "main", True, "archived", 5, 0, None),
    ]
    recipes = spark.createDataFrame(rows, RECIPES)
    got = R.suggest_rotation(recipes, at.date(), limit=5).collect()
    assert [(r.id, r.score, r.days_since_cooked) for r in got] == [(1, 1.0, 365), (3, 0.85, None), (2, 0.6, 12)]
    lines = spark.createDataFrame([(1, 1)] * 9 + [(2, 1)] * 4, "recipe_id int, seq int")
    easy = R.suggest_easy(recipes, lines, at.date(), limit=5).collect()
    # Recipe 1 has too many parts, recipe 3 scores its zero minutes as the maximum.
    assert [(r.id, r.ingredient_count, r.score) for r in easy] == [(4, 0, 2.367), (3, 0, 1.5), (2, 4, 1.033)]


@pytest.mark.parametrize("limit", [1, 2, 40, None])
def test_rotation_scores_every_candidate(spark, limit):
    rows = [(i, "often", "", "de", 20, "easy", "main", True, "active", 5, 3, datetime(2023, 12, 23)) for i in range(29)]
    rows.append((99, "never", "", "de", 20, "easy", "main", True, "active", 4, 0, None))
    best = R.suggest_rotation(spark.createDataFrame(rows, RECIPES), date(2024, 1, 1), limit=limit).first()
    assert (best.id, best.score) == (99, 0.85)


@pytest.mark.parametrize(
    "sql",
    [
        r"with t as (select '\'' as a) insert into foo select '' from t",
        "select reflect('java.lang.System', 'getProperty', 'user.dir')",
        "select `java_method`('java.lang.System', 'getProperty', 'user.dir')",
        "select try_reflect/* x */('java.lang.System', 'getProperty', 'user.dir')",
        "select transform(a) using 'cat' as (b) from t",
    ],
)
def test_hidden_writes_and_calls_are_refused(spark, sql):
    with pytest.raises((QueryError, ParseException)):
        S.run_query(spark, sql)


def test_trends_and_history(spark):
    log = spark.createDataFrame(
        [
            (1, 1, date(2024, 1, 30), 4, 5, None, datetime(2024, 1, 30, 9)),
            (2, 1, date(2024, 1, 30), 4, None, None, datetime(2024, 1, 30, 10)),
            (3, 2, date(2024, 1, 1), 4, 3, None, datetime(2024, 1, 1)),
            (4, 9, date(2023, 12, 31), 4, 1, None, datetime(2023, 12, 31)),
        ],
        "id long, recipe_id int, cooked_on date, servings int, rating int, notes string, logged_at timestamp_ntz",
    )
    recipes = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    as_of = date(2024, 1, 31)
    assert [tuple(r) for r in T.weekly_trends(log, as_of).collect()] == [("2023-W52", 1, 1), ("2024-W01", 1, 1), ("2024-W05", 2, 1)]
    assert [tuple(r) for r in T.monthly_trends(log, as_of).collect()] == [("2023-12", 1, 1), ("2024-01", 3, 2)]
    trend, top = T.cooking_frequency(log, recipes, as_of, "monthly", 1)
    assert [tuple(r) for r in trend.collect()] == [("2023-12", 1, 1), ("2024-01", 3, 2)]
    assert [(r.recipe_id, r.title, r.cook_count) for r in top.collect()] == [(1, "a", 2), (2, "b", 1), (9, None, 1)]
    assert {r.recipe_id: r.latest_rating for r in T.cook_stats(log).collect()} == {1: 5, 2: 3, 9: 1}
    assert [r.id for r in T.cook_history(log, recipes).collect()] == [2, 1, 3]
    assert [r.id for r in T.cook_history(log, recipes, recipe_id=2).collect()] == [3]
