"""Registered queries: every operator run over the whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import durations as D
from larder.functions import text as X
from larder.functions import urls as U
from larder.operators import changes as CH
from larder.operators import classify as C
from larder.operators import events as EV
from larder.operators import ingest as I
from larder.operators import promotions as P
from larder.operators import quality as Q
from larder.operators import recommend as R
from larder.operators import render as M
from larder.operators import resolve as N
from larder.operators import search as S
from larder.operators import tags as TG
from larder.operators import trends as T
from larder.operators import views as VW
from larder.plans.bindings import Bindings
from larder.plans.joins import dense_ids, group_ordinals, join_dimension, spread
from larder.session import ensure_checkpoint_dir
from larder.sources import pages as PG
from larder.sources import sitemaps as SM
from larder.sources import structured as SD
from larder.schemas import schema_for
from larder.sources.tables import (
    append_table,
    conform,
    read_table,
    register_views,
    seed_empty_tables,
    seed_if_empty,
    table_counts,
    with_computed_tags,
    write_fingerprint,
    write_table,
)
from larder.streaming.event_stats import event_stream, read_window_stats, start_window_parts
from larder.streaming.ingest_stream import record_stream, start_ingest

EVENTS_AS_OF = date(2024, 1, 31)
ORDERS_AS_OF = date(2001, 8, 2)
PROMOTIONS_AS_OF = date(1998, 6, 15)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _query(fn: Callable[[Bindings], DataFrame]) -> Callable[[Bindings], DataFrame]:
    _QUERIES[fn.__name__] = lambda spark, folder: fn(Bindings(spark, folder))
    return fn


def _joined(column: str) -> F.Column:
    return F.array_join(column, "|").alias(column)


# --- recommenders ---------------------------------------------------------------------------------


def _coverage(b: Bindings, **kw) -> DataFrame:
    df = R.suggest_for_pantry(
        b.recipes(), b.recipe_ingredients(), b.ingredients(), b.pantry(),
        extras=["part 7", "part 11", "part 23", "part 42"], **kw,
    )
    return df.withColumn("missing_ingredients", F.array_join("missing_ingredients", "|"))


@_query
def coverage_ranking(b: Bindings) -> DataFrame:
    return _coverage(b, limit=25)


@_query
def coverage_all(b: Bindings) -> DataFrame:
    return _coverage(b, limit=None, max_total_minutes=60, missing_ok=1)


@_query
def rotation_ranking(b: Bindings) -> DataFrame:
    return R.suggest_rotation(b.recipes(), ORDERS_AS_OF, min_rating=3, not_cooked_in_days=365, limit=20).select(
        "id", "owner_rating", "times_cooked", "days_since_cooked", "score"
    )


@_query
def rotation_all(b: Bindings) -> DataFrame:
    return R.suggest_rotation(b.recipes(), ORDERS_AS_OF, min_rating=2, not_cooked_in_days=900, limit=None).select(
        "id", "owner_rating", "times_cooked", "days_since_cooked", "score"
    )


@_query
def easy_ranking(b: Bindings) -> DataFrame:
    return R.suggest_easy(b.recipes(), b.recipe_ingredients(), ORDERS_AS_OF, avoid_recent_days=500, limit=20).select(
        "id", "title", "total_minutes", "difficulty", "ingredient_count", "score"
    )


@_query
def easy_all(b: Bindings) -> DataFrame:
    return R.suggest_easy(
        b.recipes(), b.recipe_ingredients(), ORDERS_AS_OF, max_total_minutes=70, max_ingredients=5,
        avoid_recent_days=900, limit=None,
    ).select("id", "total_minutes", "difficulty", "ingredient_count", "score")


@_query
def available_keys(b: Bindings) -> DataFrame:
    return R.available_keys(b.pantry(), b.ingredients(), extras=["part 7"])


@_query
def part_key_chunks(b: Bindings) -> DataFrame:
    """Ordered part keys per recipe, in chunks of a fixed length."""
    keys = R.part_keys(b.recipe_ingredients(), b.ingredients()).select("recipe_id", "seq", "key")
    numbered = group_ordinals(keys, ["recipe_id"], [F.col("seq"), F.col("key")], "n")
    return (
        numbered.groupBy("recipe_id", F.floor((F.col("n") - 1) / 1000).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("k"))
        .select("recipe_id", "chunk", F.array_join(F.transform("k", lambda x: x["key"]), "|").alias("keys"))
    )


@_query
def pairing_tag_ranking(b: Bindings) -> DataFrame:
    tags = R.pairing_tags(b.ingredients(), b.recipe_ingredients())
    return R.suggest_by_tags(b.recipes(), tags, ["promo", "hot", "red", "small"], limit=30)


@_query
def promotion_value_ranking(b: Bindings) -> DataFrame:
    promos = b.promotions()
    offers = P.best_offers(promos, promos.selectExpr("id as promotion_id", "ingredient_id").distinct(), PROMOTIONS_AS_OF)
    return P.suggest_for_promotions(b.recipes(), b.recipe_ingredients(), offers, limit=30).select(
        "recipe_id", "title", "n_on_offer", F.round("value", 3).alias("value")
    )


@_query
def shopping_list(b: Bindings) -> DataFrame:
    plan = b.recipes().filter("starred").select(F.col("id").alias("recipe_id"), F.lit(2.0).alias("scale"))
    return R.shopping_list(b.recipe_ingredients(), b.ingredients(), plan, b.pantry()).select(
        "ingredient_id", "unit", "needed", "in_stock", "to_buy", "key", "category"
    )


# --- search and listings ----------------------------------------------------------------------------


@_query
def find_by_text(b: Bindings) -> DataFrame:
    return S.find_recipes(
        b.recipes(), query="PRÉPARÉ  low", language="de", max_total_minutes=45, difficulty="easy", limit=20
    )


@_query
def find_by_tags(b: Bindings) -> DataFrame:
    return S.find_recipes(
        b.recipes(), course="main", tags=["Promo", "SMALL", "economy"], tag_table=b.tags(),
        recipe_tags=b.recipe_tags(), limit=None,
    )


@_query
def find_without_tags(b: Bindings) -> DataFrame:
    return S.find_recipes(
        b.recipes(), tags=["promo"], without_tags=["small", "large"], tag_table=b.tags(),
        recipe_tags=b.recipe_tags(), include_inactive=False, limit=None,
    )


@_query
def all_of_tags(b: Bindings) -> DataFrame:
    return S.having_all_tags(b.recipe_tags(), b.tags(), ["promo", "small", "large", "economy"])


@_query
def search_titles(b: Bindings) -> DataFrame:
    return S.search_recipes(b.recipes(), query="Plat 13", language="fr", limit=25).select("id", "title", "language")


@_query
def starred_recipes(b: Bindings) -> DataFrame:
    return S.starred(b.recipes(), limit=50)


@_query
def active_recipes(b: Bindings) -> DataFrame:
    return S.active_recipes(b.recipes())


@_query
def pantry_contents(b: Bindings) -> DataFrame:
    return S.pantry_listing(b.pantry(), b.ingredients())


@_query
def tag_listing(b: Bindings) -> DataFrame:
    return S.dimension_listing(b.tags(), ["id", "key", "display", "facet"])


@_query
def recent_cook_log(b: Bindings) -> DataFrame:
    return S.recent_cook_log(b.cook_log(), b.recipes(), limit=50)


@_query
def cook_history(b: Bindings) -> DataFrame:
    return T.cook_history(b.cook_log(), b.recipes(), limit=40).select(
        "id", "recipe_id", "title", "cooked_on", "servings", "rating", "notes"
    )


@_query
def last_events_per_recipe(b: Bindings) -> DataFrame:
    order = [F.col("cooked_on").desc(), F.col("logged_at").desc()]
    return S.last_events(b.cook_log(), "recipe_id", order, 5).select("recipe_id", "id", "cooked_on", "rating", "rank")


@_query
def recipe_details(b: Bindings) -> DataFrame:
    return S.recipe_details(
        [3, 17, 42], b.recipes(), b.recipe_ingredients(), b.recipe_steps(), b.cook_log()
    ).filter("section != 'ingredients' or text is not null")


@_query
def computed_tags(b: Bindings) -> DataFrame:
    return with_computed_tags(b.recipes()).select("id", _joined("computed_tags"))


@_query
def adhoc_sql(b: Bindings) -> DataFrame:
    b.recipes().createOrReplaceTempView("recipes")
    return S.run_query(
        b.spark,
        "SELECT language, course, COUNT(*) AS n, MIN(total_minutes) AS fastest FROM recipes "
        "WHERE owner_rating >= ? GROUP BY language, course -- update",
        params=[3],
        limit=100,
    )


@_query
def promotions_search(b: Bindings) -> DataFrame:
    return P.find_promotions(
        b.promotions(), b.retailers(), retailer="Supplier#000000007", product="ITEM 1", min_discount_pct=5.0, limit=50
    ).drop("id")


@_query
def promotions_unexpired(b: Bindings) -> DataFrame:
    return P.unexpired(b.promotions(), PROMOTIONS_AS_OF, limit=50)


@_query
def best_offers(b: Bindings) -> DataFrame:
    promos = b.promotions()
    mapping = promos.selectExpr("id as promotion_id", "ingredient_id").distinct()
    return P.best_offers(promos, mapping, PROMOTIONS_AS_OF)


@_query
def discounts(b: Bindings) -> DataFrame:
    price = F.when(F.col("id") % 11 == 0, 0.0).otherwise(F.col("regular_price_chf"))
    return b.promotions().select("id", F.round(P.discount_pct(price, F.col("price_chf")), 4).alias("pct"))


# --- aggregates ---------------------------------------------------------------------------------------


@_query
def collection_stats(b: Bindings) -> DataFrame:
    return T.collection_stats(b.recipes())


@_query
def weekly_trends(b: Bindings) -> DataFrame:
    return T.weekly_trends(b.cook_log(), EVENTS_AS_OF, weeks=3)


@_query
def monthly_trends(b: Bindings) -> DataFrame:
    """Monthly trend over the order dates, with the customer as the recipe."""
    log = b.raw("orders").selectExpr("o_custkey as recipe_id", "cast(o_orderdate as date) as cooked_on")
    return T.monthly_trends(log, ORDERS_AS_OF, months=30)


@_query
def top_cooked(b: Bindings) -> DataFrame:
    return T.top_recipes(b.cook_log(), b.recipes(), limit=10)


@_query
def cook_stats(b: Bindings) -> DataFrame:
    return T.cook_stats(b.cook_log())


@_query
def cooking_frequency(b: Bindings) -> DataFrame:
    """Trend of the weeks and the most cooked recipes, one below the other."""
    trend, best = T.cooking_frequency(b.cook_log(), b.recipes(), EVENTS_AS_OF, "weekly", 4)
    return trend.selectExpr("'trend' as part", "period as name", "cook_count", "unique_recipes").unionByName(
        best.selectExpr("'top' as part", "title as name", "cook_count", "cast(null as bigint) as unique_recipes")
    )


@_query
def recipe_full_view(b: Bindings) -> DataFrame:
    images = b.raw("orders").selectExpr(
        "o_orderkey as recipe_id", "explode(slice(array(3, 1, 2), 1, cast(o_custkey % 4 as int))) as seq"
    ).selectExpr("recipe_id", "seq", "concat('https://shop.example.org/', recipe_id, '-', seq, '.jpg') as url")
    return VW.recipe_full(b.recipes(), b.cook_log(), images).select(
        "id", "title", "cuisine", "course", "log_times_cooked", "log_last_cooked_on", "log_latest_rating", "primary_image"
    )


@_query
def ingredients_resolved_view(b: Bindings) -> DataFrame:
    return VW.ingredients_resolved(b.recipe_ingredients(), b.ingredients()).select(
        "recipe_id", "seq", "ingredient_id", "raw_text", "ingredient_key", "ingredient_display_de", "ingredient_category"
    )


@_query
def tool_event_stats(b: Bindings) -> DataFrame:
    return EV.event_stats(b.tool_events())


@_query
def tool_breakdown(b: Bindings) -> DataFrame:
    return EV.tool_stats(b.tool_events())


@_query
def recent_tool_events(b: Bindings) -> DataFrame:
    return EV.recent_events(b.tool_events(), 20).select("event_id", "tool", "duration_ms", "success", "error")


@_query
def row_counts(b: Bindings) -> DataFrame:
    tables = ["orders", "lineitem", "part", "events", "documents", "pages"]
    return table_counts({t: b.raw(t) for t in tables})


# --- data quality -------------------------------------------------------------------------------------


@_query
def quality_report(b: Bindings) -> DataFrame:
    recipes = b.recipes().withColumn("title", F.when(F.col("id") % 501 != 0, F.col("title")))
    lines = b.recipe_ingredients().withColumn("recipe_id", F.when(F.col("seq") == 7, -F.col("recipe_id") % 97 - 1).otherwise(F.col("recipe_id")))
    return Q.validate_tables(
        {"recipes": recipes, "recipe_ingredients": lines, "recipe_steps": b.recipe_steps(), "cook_log": b.cook_log()}
    )


@_query
def recipes_without_lines(b: Bindings) -> DataFrame:
    return Q.orphans(b.raw("orders"), b.raw("lineitem"), "o_orderkey", "l_orderkey", "orders_without_lines")


@_query
def unlabelled_documents(b: Bindings) -> DataFrame:
    return Q.orphans(b.raw("documents"), b.raw("labels"), "doc_id", "doc_id", "documents_without_labels")


@_query
def duplicate_lines(b: Bindings) -> DataFrame:
    return Q.duplicates(b.raw("lineitem"), ["l_orderkey", "l_linenumber"], "duplicate_lines")


@_query
def conformed_recipes(b: Bindings) -> DataFrame:
    df = conform(b.recipes().select("id", "title", "language", "total_minutes", "owner_rating", "starred"), "recipes")
    return df.groupBy("language", "owner_rating", "starred").agg(
        F.count("title").alias("titles"), F.count("scraped_at").alias("scraped"), F.sum("total_minutes").alias("minutes")
    )


# --- change application -------------------------------------------------------------------------------


def _at(column: str = "ts") -> F.Column:
    return F.col(column).cast("timestamp_ntz")


@_query
def star_changes(b: Bindings) -> DataFrame:
    changes = b.raw("events").select(
        F.col("user_id").alias("recipe_id"), (F.col("event_type") != "error").alias("starred"), _at().alias("changed_at")
    )
    return CH.star_recipes(b.recipes().select("id", "title", "starred"), changes)


@_query
def rating_changes(b: Bindings) -> DataFrame:
    changes = b.raw("events").select(
        F.col("user_id").alias("recipe_id"),
        F.when(F.col("event_type") != "view", F.floor("value").cast("int") % 8).alias("owner_rating"),
        _at().alias("changed_at"),
    )
    return CH.rate_recipes(b.recipes().select("id", "owner_rating"), changes)


def _logged(b: Bindings) -> CH.CookLogResult:
    log = b.cook_log()
    old = log.filter("logged_at < timestamp_ntz '2024-01-20 00:00:00'")
    new = (
        log.filter("logged_at >= timestamp_ntz '2024-01-20 00:00:00'")
        .drop("id")
        .withColumn("recipe_id", F.when(F.col("notes") == "signup", -F.col("recipe_id")).otherwise(F.col("recipe_id")))
        .withColumn("rating", F.when(F.col("notes") == "click", 9).otherwise(F.col("rating")))
    )
    pins = b.recipes().filter("starred").select(
        "id", F.col("id").alias("recipe_id"), F.lit("pinned").alias("status"), F.lit("x").alias("note")
    )
    return CH.log_cooks(old, b.recipes().select("id", "times_cooked", "last_cooked_at", "owner_rating"), new, EVENTS_AS_OF, pins)


@_query
def logged_cooks(b: Bindings) -> DataFrame:
    return _logged(b).cook_log.select("id", "recipe_id", "cooked_on", "rating", "notes")


@_query
def logged_cook_recipes(b: Bindings) -> DataFrame:
    return _logged(b).recipes.select(
        "id", "times_cooked", F.col("last_cooked_at").cast("date").alias("last_cooked_on"), "owner_rating"
    )


@_query
def logged_cook_rejects(b: Bindings) -> DataFrame:
    return _logged(b).rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@_query
def logged_cook_pins(b: Bindings) -> DataFrame:
    return _logged(b).pins.select("id", "recipe_id", "status")


def _pins(b: Bindings) -> DataFrame:
    return b.recipes().filter("starred").select(
        "id",
        F.col("id").alias("recipe_id"),
        D.utc_literal(datetime(2024, 1, 1)).alias("pinned_at"),
        F.when(F.col("id") % 3 == 0, F.col("last_cooked_at").cast("date")).alias("target_date"),
        F.lit(None).cast("string").alias("note"),
        F.when(F.col("id") % 4 == 0, "cooked").when(F.col("id") % 7 == 0, "dismissed").otherwise("pinned").alias("status"),
    )


@_query
def pin_requests(b: Bindings) -> DataFrame:
    requests = b.raw("events").select(
        F.col("user_id").alias("recipe_id"), _at().alias("pinned_at"), F.col("ts").cast("date").alias("target_date"),
        F.col("event_type").alias("note"),
    )
    return CH.pin_recipes(_pins(b), b.recipes(), requests).select("id", "recipe_id", "target_date", "note", "status")


@_query
def unpin_requests(b: Bindings) -> DataFrame:
    gone = b.raw("events").filter("event_type = 'error'").select(F.col("user_id").alias("recipe_id"))
    return CH.close_pins(_pins(b), gone, "dismissed").select("id", "recipe_id", "status")


@_query
def pinboard(b: Bindings) -> DataFrame:
    return CH.list_pins(_pins(b), b.recipes(), include_done=True).select(
        "id", "recipe_id", "title", "target_date", "status"
    )


def _pantry_change(b: Bindings) -> CH.PantryResult:
    names = b.ingredients().select(F.col("id").alias("l_partkey"), "key")
    moves = join_dimension(b.raw("lineitem").select("l_partkey", "l_returnflag", "l_quantity", "l_shipdate", "l_tax"), names, "l_partkey")
    additions = moves.filter("l_returnflag = 'A'").select(
        F.when(F.col("l_tax") == 0.0, F.concat(F.lit("new-"), F.col("key"))).otherwise(F.col("key")).alias("key"),
        F.col("l_quantity").alias("approx_quantity"),
        F.lit("g").alias("unit"),
        F.lit("fridge").alias("location"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("updated_at"),
        F.lit(None).cast("string").alias("note"),
    )
    removals = moves.filter("l_returnflag = 'R' and l_tax = 0.08").select("key")
    return CH.update_pantry(b.pantry(), b.ingredients(), additions, removals)


@_query
def pantry_changes(b: Bindings) -> DataFrame:
    return _pantry_change(b).pantry.select(
        "ingredient_id", "approx_quantity", "unit", "location", F.col("updated_at").cast("date").alias("updated_on")
    )


@_query
def pantry_unknown_keys(b: Bindings) -> DataFrame:
    return _pantry_change(b).unknown


@_query
def own_recipes(b: Bindings) -> DataFrame:
    entries = b.raw("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("entry_no"),
        F.when(F.col("turn") % 4 == 2, "  ").otherwise(F.col("text")).alias("title"),
        F.split("text", r"\.").alias("ingredients"),
        F.split("text", "\n").alias("steps"),
        F.lit(4).alias("servings"),
        F.when(F.col("conv_id") % 3 > 0, F.col("turn") + 10).cast("int").alias("prep_minutes"),
        F.when(F.col("conv_id") % 2 > 0, F.col("turn") + 20).cast("int").alias("cook_minutes"),
        F.lit("easy").alias("difficulty"),
        D.utc_literal(datetime(2024, 1, 1)).alias("entered_at"),
    )
    added = CH.add_own_recipes(b.recipes(), entries, 6)
    steps = added.recipe_steps.groupBy(F.col("recipe_id").alias("id")).agg(F.max("step_no").alias("n_steps"))
    return added.recipes.join(steps, "id").select(
        "id", "source_external_id", "title_normalised", "prep_minutes", "cook_minutes", "total_minutes", "n_steps"
    )


def _assignments(b: Bindings) -> DataFrame:
    return b.raw("events").select(
        F.col("user_id").alias("recipe_id"),
        F.concat(F.initcap("event_type"), F.lit(" & Größe "), (F.col("user_id") % 5).cast("string")).alias("tag"),
    )


@_query
def user_tags(b: Bindings) -> DataFrame:
    return TG.user_tags(_assignments(b), b.recipes(), b.tags(), b.recipe_tags()).tags


@_query
def user_tag_links(b: Bindings) -> DataFrame:
    return TG.user_tags(_assignments(b), b.recipes(), b.tags(), b.recipe_tags()).links


# --- text, lines, names -------------------------------------------------------------------------------


@_query
def normalised_texts(b: Bindings) -> DataFrame:
    return b.raw("documents").select("doc_id", F.sha2(X.normalise_title(F.col("text")), 256).alias("digest"))


@_query
def text_slugs(b: Bindings) -> DataFrame:
    return b.raw("documents").select("doc_id", F.sha2(X.tag_slug(F.col("text")), 256).alias("digest"))


@_query
def keyword_splits(b: Bindings) -> DataFrame:
    words = X.split_keywords(F.col("text"))
    return b.raw("documents").select("doc_id", F.size(words).alias("n"), F.sha2(F.array_join(words, "|"), 256).alias("digest"))


@_query
def content_first_seen(b: Bindings) -> DataFrame:
    """First document of every distinct content."""
    digest = X.content_hash(F.col("lang"), F.lit(""), F.split("text", r"\."), F.split("text", "\n"))
    return (
        b.raw("documents").select("doc_id", digest.alias("content_hash"))
        .groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    )


@_query
def word_mentions(b: Bindings) -> DataFrame:
    """Documents in which a word equals, starts or ends with one of the given words."""
    return b.raw("documents").select(
        "doc_id", C.mentions(F.col("text"), ["heit", "ung", "tion", "lich"]).alias("mentioned")
    )


_QUALIFIER = "case l_linenumber % 3 when 0 then 'frische ' when 1 then 'grob gehackte ' else '' end"
_NOTE = "case l_returnflag when 'A' then ', in Streifen' when 'N' then ' (fein)' else '' end"
_NAME = (
    "case when l_tax = 0.0 then concat('Xylophon ', cast(l_orderkey % 7 as string))"
    " when l_partkey % 4 = 0 then concat(p_name, 'n') else p_name end"
)
_UNIT = "case l_linenumber % 4 when 0 then 'g' when 1 then 'EL' when 2 then 'dl' else 'Prisen' end"


def _text_lines(b: Bindings) -> DataFrame:
    parts = b.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = spread(
        b.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_tax")
    )
    return join_dimension(lines, parts, "l_partkey").selectExpr(
        "l_orderkey as recipe_id",
        "l_linenumber as seq",
        "l_partkey as part",
        f"concat(cast(cast(l_quantity as int) as string), ' ', {_UNIT}, ' ', {_QUALIFIER}, {_NAME}, {_NOTE}) as raw_text",
    )


def _name_catalogue(b: Bindings) -> DataFrame:
    none = F.lit(None).cast("string")
    return (
        b.raw("part")
        .groupBy("p_name")
        .agg(F.min("p_partkey").alias("id"))
        .select(
            "id",
            F.replace("p_name", F.lit(" "), F.lit("-")).alias("key"),
            F.initcap("p_name").alias("display_de"),
            none.alias("display_fr"),
            none.alias("display_it"),
            none.alias("display_en"),
            F.array(F.concat("p_name", F.lit(" extra"))).alias("aliases"),
        )
    )


@_query
def parsed_lines(b: Bindings) -> DataFrame:
    return N.parse_texts(_text_lines(b)).select("recipe_id", "seq", "part", "quantity", "unit", "ingredient", "prep_note", "optional")


@_query
def resolved_lines(b: Bindings) -> DataFrame:
    ensure_checkpoint_dir(b.spark)
    parsed = N.parse_texts(_text_lines(b)).select("recipe_id", "seq", "part", "ingredient").checkpoint()
    resolved = N.resolve_lines(parsed, N.alias_index(_name_catalogue(b)))
    return resolved.select("recipe_id", "seq", "part", "ingredient", "ingredient_key", "ingredient_id")


@_query
def catalogue_aliases(b: Bindings) -> DataFrame:
    return N.alias_index(_name_catalogue(b))


@_query
def order_durations(b: Bindings) -> DataFrame:
    """Durations written in several ways from the order key, read back as minutes."""
    text = F.expr(
        "case o_orderkey % 5"
        " when 0 then concat('PT', cast(o_orderkey % 7 as string), 'H', cast(o_orderkey % 50 as string), 'M', cast(o_orderkey % 60 as string), 'S')"
        " when 1 then concat(cast(o_orderkey % 4 + 1 as string), ' Std ', cast(o_orderkey % 50 as string), ' Min.')"
        " when 2 then concat('ca. ', cast(o_orderkey % 200 as string), ' min')"
        " when 3 then concat('PT', cast(o_orderkey as string), 'M')"
        " else 'keine Angabe' end"
    )
    return b.raw("orders").select("o_orderkey", D.duration_minutes(text).alias("minutes"))


@_query
def reconciled_times(b: Bindings) -> DataFrame:
    orders = b.raw("orders").selectExpr(
        "o_orderkey",
        "case when o_orderkey % 7 > 0 then cast(o_orderkey % 50 + 1 as int) end as p",
        "case when o_orderkey % 3 > 0 then cast(o_custkey % 50 + 1 as int) end as c",
        "case when o_orderkey % 2 > 0 then cast(o_custkey % 90 as int) end as t",
    )
    times = D.reconcile_times(F.col("p"), F.when(F.col("o_orderkey") % 5 == 0, F.col("p")).otherwise(F.col("c")), F.col("t"))
    return orders.select(
        "o_orderkey", times.prep.alias("prep"), times.cook.alias("cook"), times.total.alias("total")
    )


@_query
def page_url_fields(b: Bindings) -> DataFrame:
    url = F.col("url")
    language = SM.detect_language(url)
    return b.raw("pages").select(
        "page_id",
        U.external_id(url, language).alias("external_id"),
        language.alias("language"),
        U.slug_words(url).alias("slug"),
        U.image_key(F.col("page_id"), F.lit(3), url).alias("image_key"),
    )


@_query
def resized_images(b: Bindings) -> DataFrame:
    url = F.concat(
        F.when(F.col("o_orderkey") % 5 == 0, "https://img.example.org/").otherwise("https://recipeimages.migros.ch/"),
        F.lit("crop/v-w-"), (F.col("o_orderkey") % 2000 + 1).cast("string"), F.lit("-h-"),
        (F.col("o_custkey") % 1500 + 1).cast("string"), F.lit("-a-center/x.jpg"),
    )
    return b.raw("orders").select("o_orderkey", U.resized_url(url, 1200).alias("url"))


# --- classification -------------------------------------------------------------------------------------

_TITLES = [
    "Rindssteak mit Pesto", "Zitronentorte", "Pad Thai mit Poulet", "Quinoasalat", "Spaghetti Carbonara",
    "Avocado-Dip", "Gemüseauflauf", "Birchermüesli", "Zürcher Geschnetzeltes", "Currywurst", "Etwas ganz anderes",
]


def _records(b: Bindings) -> DataFrame:
    """Raw records written from the orders."""
    titles = F.array(*[F.lit(t) for t in _TITLES])
    o = F.col("o_orderkey")
    return b.raw("orders").select(
        F.col("o_orderkey").alias("recipe_id"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("source_id"),
        F.col("o_orderkey").alias("position"),
        F.get(titles, (o % len(_TITLES)).cast("int")).alias("title"),
        F.lit("").alias("description"),
        F.array(
            F.lit("2 EL Sojasauce"),
            F.when(o % 6 == 0, "1 Stück Ingwer").when(o % 6 == 1, "200 g Linsen").otherwise("Wasser"),
            F.concat(F.when(F.col("o_custkey") % 3 == 0, "200 g Sonderware ").otherwise("200 g Ware "), F.col("o_custkey").cast("string")),
        ).alias("ingredients_raw"),
        F.array().cast("array<struct<label:string,items:array<string>>>").alias("ingredient_groups"),
        F.array(
            F.when(o % 4 == 0, "Fleisch grillieren.").when(o % 4 == 1, "Im Ofen 20 Min. backen.").when(
                o % 4 == 2, "Zugedeckt schmoren, dann kochen."
            ).otherwise("Servieren."),
        ).alias("steps_raw"),
        F.lit("4 Portionen").alias("yield_amount"),
        F.concat((o % 70).cast("string"), F.lit(" min")).alias("prep_time"),
        F.lit("").alias("cook_time"),
        F.lit("").alias("total_time"),
        F.array().cast("array<string>").alias("image_urls"),
        F.array().cast("array<string>").alias("image_captions"),
        F.when(o % 10 == 0, F.array(F.lit("Dessert"), F.lit("Einfach")))
        .when(o % 10 == 1, F.array(F.lit("Fleisch"), F.lit("Grillieren"), F.lit("Für Gäste")))
        .when(o % 10 == 2, F.array(F.lit("Sommer"), F.lit("Mittel"), F.lit("Spanisch & Co")))
        .otherwise(F.array().cast("array<string>"))
        .alias("keywords"),
        F.concat(
            F.lit("https://shop.example.org/de/rezepte/"),
            F.when(o % 9 == 0, "japanische-suppe-").otherwise("teller-"),
            o.cast("string"),
        ).alias("source_url"),
        F.when(o % 13 == 0, "en").otherwise("de").alias("language"),
        F.when(o % 8 == 0, " Hauptgericht ").when(o % 8 == 1, "Sonstiges").otherwise("").alias("category"),
        F.when(o % 12 == 0, "Italienisch").when(o % 12 == 1, "milch, käse").when(o % 12 == 2, "Backen").otherwise("").alias(
            "cuisine"
        ),
        F.when(o % 5 == 0, "Schwierig").otherwise("").alias("difficulty"),
        F.when(o % 97 == 0, "broken page").alias("error"),
    )


@_query
def classified_records(b: Bindings) -> DataFrame:
    return C.classification(_records(b)).select("recipe_id", "course", "cuisine", "difficulty")


@_query
def cooking_methods(b: Bindings) -> DataFrame:
    return _records(b).select("recipe_id", C.cooking_method(F.col("steps_raw"), F.col("keywords")).alias("method"))


@_query
def line_cuisines(b: Bindings) -> DataFrame:
    return _records(b).select("recipe_id", C.cuisine_from_lines(F.col("ingredients_raw")).alias("cuisine"))


def _food_catalogue(b: Bindings) -> DataFrame:
    """Parts as a food catalogue: type gives the category, brand number the sub-category."""
    return b.raw("part").selectExpr(
        "p_partkey as id",
        "case when p_type = 'SMALL' and p_size <= 25 then 'sugar' else concat('part-', cast(p_partkey as string)) end as key",
        "case when p_size = 50 then 'Rauchlachs Stück' else p_name end as display_de",
        "case p_type when 'ECONOMY' then 'meat' when 'LARGE' then 'fish' when 'MEDIUM' then 'dairy'"
        " when 'PROMO' then 'vegetable' when 'SMALL' then 'pantry' else 'fruit' end as category",
        "case p_type when 'ECONOMY' then get(array('beef', 'poultry', 'cured', 'offal'), cast(p_size % 4 as int))"
        " when 'LARGE' then get(array('white-fish', 'shellfish'), cast(p_size % 2 as int))"
        " when 'MEDIUM' then get(array('cream', 'milk'), cast(p_size % 2 as int)) end as sub_category",
        "array(case p_size % 3 when 0 then 'nut' when 1 then 'red-meat' else 'grain' end, 'other') as pairing_tags",
    )


def _food_lines(b: Bindings) -> DataFrame:
    lines = b.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return spread(lines).selectExpr(
        "l_orderkey as recipe_id",
        "l_linenumber as seq",
        "case when l_linenumber > 3 then l_partkey end as ingredient_id",
        "case l_partkey % 6 when 0 then '200 g Pouletbrust,' when 1 then 'Rauchlachs' when 2 then 'Rinds-Filet'"
        " else 'Salz' end as raw_text",
        "l_quantity as quantity",
    )


@_query
def classified_parts(b: Bindings) -> DataFrame:
    recipes = b.raw("orders").selectExpr(
        "o_orderkey as recipe_id",
        "case o_orderkey % 6 when 0 then 'dessert' when 1 then 'starter' end as course",
        "case o_orderkey % 5 when 0 then 90 when 1 then 10 end as cook_minutes",
        "cast(o_orderkey % 60 as int) as total_minutes",
        "case o_orderkey % 7 when 0 then array('Kuchen') when 1 then array('Deftig', 'Salat') else array() end as keywords",
    )
    return C.classify_parts(recipes, _food_lines(b), _food_catalogue(b)).select(
        "recipe_id", "primary_protein", "taste_profile", "weight_class", _joined("dietary_flags"), _joined("food_groups")
    )


@_query
def keyword_tag_rows(b: Bindings) -> DataFrame:
    return TG.keyword_tags(_records(b), b.tags()).tags


@_query
def keyword_tag_links(b: Bindings) -> DataFrame:
    rows = TG.keyword_tags(_records(b), b.tags())
    return rows.links.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"), F.min("recipe_id").alias("first_recipe"))


@_query
def classification_tag_rows(b: Bindings) -> DataFrame:
    return TG.classification_tags(b.recipes(), b.tags()).tags


# --- ingest ---------------------------------------------------------------------------------------------


def _document_records(b: Bindings) -> DataFrame:
    """Documents as raw records: the language is the source, sentences are ingredient lines."""
    return b.raw("documents").select(
        F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang")).cast("int").alias("source_id"),
        F.col("doc_id").alias("position"),
        F.lit("doc").alias("title"),
        F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.col("lang").alias("language"),
        F.split("text", r"\.").alias("ingredients_raw"),
        F.split("text", "\n").alias("steps_raw"),
        F.when(F.col("doc_id") % 41 == 0, "broken").alias("error"),
    )


def _validated_records(b: Bindings) -> DataFrame:
    """Documents as raw records, of which those without a word have neither lines nor steps, so that they fail the validity check."""
    worded = F.array_join("steps_raw", "").rlike(r"[^\x00-\x20]")
    return _document_records(b).withColumns(
        {c: F.when(worded, F.col(c)).otherwise(F.array().cast("array<string>")) for c in ("ingredients_raw", "steps_raw")}
    )


def _stored_recipes(records: DataFrame) -> DataFrame:
    """Every tenth document is stored already, some of them under another address."""
    return I.with_hash(records).filter("position % 10 = 0").select(
        F.when(F.col("position") % 20 == 0, F.col("source_url")).otherwise("https://docs.example.org/old").alias("source_url"),
        "content_hash",
    )


def _decided_documents(b: Bindings, **options) -> DataFrame:
    records = _validated_records(b)
    return I.decide(records, _stored_recipes(records), **options)


@_query
def ingest_dispositions(b: Bindings) -> DataFrame:
    return _decided_documents(b, languages=["de", "en", "fr"]).select(
        "source_id", "position", "disposition"
    )


@_query
def ingest_capped(b: Bindings) -> DataFrame:
    """With a cap on new records per source; sources share no content because the language is hashed."""
    return _decided_documents(b, limit_per_source=50).select(
        "source_id", "position", "disposition"
    )


@_query
def ingest_audit(b: Bindings) -> DataFrame:
    return I.audit(_decided_documents(b, languages=["de", "en", "fr"]))


@_query
def ingest_errors(b: Bindings) -> DataFrame:
    decided = I.decide(_document_records(b), _stored_recipes(_document_records(b)))
    return I.error_summary(decided.withColumn("error", F.concat("error", F.lit(" "), F.col("position").cast("string"))))


@_query
def ingest_error_rows(b: Bindings) -> DataFrame:
    """All records that failed, one row each."""
    return I.error_rows(I.decide(_document_records(b), _stored_recipes(_document_records(b))))


@_query
def ingest_runs(b: Bindings) -> DataFrame:
    """The log rows of a run over the documents: a source without records, one whose discovery failed, and deletions per source."""
    sources = b.spark.createDataFrame([(1, "de"), (2, "en"), (3, "es"), (4, "fr"), (5, "it"), (6, "pt")], "id int, key string")
    failures = b.spark.createDataFrame([(5, "timeout"), (1, "sitemap cut off")], "source_id int, error string")
    records = _document_records(b)
    stored = records.select("source_id", F.concat("source_url", F.lit("?old")).alias("source_url"), F.lit("active").alias("status"))
    runs = I.run_rows(
        sources, I.decide(records, _stored_recipes(_document_records(b)), languages=["de", "en", "fr"]), datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 5),
        deleted=I.vanished(stored.unionByName(records.select("source_id", "source_url", F.lit("active").alias("status"))), records), failures=failures, limit=7,
    )
    return runs.select("source", "discovered", "fetched", "skipped", "errors", "validation_skipped", "soft_deleted", "status", "duration_seconds",
                       F.substring_index("error_summary", ";", 1).alias("first_error"))


@_query
def suspicious_records(b: Bindings) -> DataFrame:
    return _document_records(b).select("position", I.suspicious_lines(F.col("ingredients_raw")).alias("reason"))


@_query
def soft_deleted(b: Bindings) -> DataFrame:
    recipes = b.recipes()
    found = recipes.filter("id % 10 > 0 and source_id < 4").select("source_id", "source_url")
    return I.soft_delete(recipes, found).groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@_query
def interrupted_runs(b: Bindings) -> DataFrame:
    runs = b.raw("events").select(
        F.col("event_id").alias("id"), _at().alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit(None).cast("double").alias("duration_seconds"), F.col("event_type").alias("source"),
        F.when(F.col("value") > 10, "running").otherwise("success").alias("status"),
    )
    return I.close_interrupted(runs, "click", datetime(2024, 2, 1)).select("id", "source", "status", "duration_seconds")


def _ingested(b: Bindings) -> I.IngestRows:
    return I.ingest(
        _records(b).drop("recipe_id"),
        b.recipes().filter("id % 10 = 0").select(
            "id",
            F.concat(F.lit("https://shop.example.org/de/rezepte/teller-"), F.col("id").cast("string")).alias("source_url"),
            F.lit(None).cast("string").alias("content_hash"),
        ),
        b.tags(),
        _ware_catalogue(b),
        datetime(2024, 1, 1),
        languages=["de"],
    )


def _ware_catalogue(b: Bindings) -> DataFrame:
    none = F.lit(None).cast("string")
    return b.raw("part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("ware-"), F.col("p_partkey").cast("string")).alias("key"),
        F.concat(F.lit("Ware "), F.col("p_partkey").cast("string")).alias("display_de"),
        none.alias("display_fr"), none.alias("display_it"), none.alias("display_en"),
        F.lit("meat").alias("category"), F.lit("beef").alias("sub_category"),
        F.array(F.lit("grain")).alias("pairing_tags"), F.array().cast("array<string>").alias("aliases"),
    )


@_query
def ingested_recipes(b: Bindings) -> DataFrame:
    return _ingested(b).recipes.select(
        "id", "source_id", "source_external_id", "title_normalised", "servings", "prep_minutes", "total_minutes",
        "course", "cuisine", "difficulty", "cooking_method", "primary_protein", "weight_class", _joined("dietary_flags"),
        _joined("food_groups"),
    )


@_query
def ingested_lines(b: Bindings) -> DataFrame:
    return _ingested(b).recipe_ingredients.select("recipe_id", "seq", "ingredient_id", "quantity", "unit", "raw_text")


@_query
def document_steps(b: Bindings) -> DataFrame:
    """Step rows of recipes whose steps are the lines of the documents."""
    records = b.raw("documents").select(F.col("doc_id").alias("recipe_id"), F.split("text", "\n").alias("steps_raw"))
    return I.step_rows(records).select("recipe_id", "step_no", F.sha2("text", 256).alias("text"), "image_url")


@_query
def document_images(b: Bindings) -> DataFrame:
    """Image rows with an address per line and the sentences as captions, of which there may be fewer or more."""
    address = lambda line, i: F.concat(F.lit("https://img.example.org/"), F.col("doc_id").cast("string"), F.lit("/"), i.cast("string"))
    records = b.raw("documents").select(
        F.col("doc_id").alias("recipe_id"), F.transform(F.split("text", "\n"), address).alias("image_urls"), F.split("text", r"\.").alias("image_captions")
    )
    return I.image_rows(records).select("recipe_id", "seq", "url", "local_path", F.sha2("caption", 256).alias("caption"))


@_query
def french_names(b: Bindings) -> DataFrame:
    """Parts under French names: with measures, articles, elisions, quantities, plurals and hyphens, and some that nobody sells."""
    line = F.col("l_linenumber")
    name = (
        F.when(line == 1, F.concat(F.lit("une pincée de "), "p_name"))
        .when(line == 2, F.concat(F.lit("un peu d'"), F.initcap("p_name")))
        .when(line == 3, F.concat(F.lit("quelques "), "p_name", F.lit("s")))
        .when(line == 4, F.concat(F.lit("200 g "), F.upper("p_name")))
        .when(line == 5, F.concat(F.lit("de la "), "p_name", F.lit(", coupé fin")))
        .when(line == 6, F.concat(F.lit("Bio-"), F.replace("p_name", F.lit(" "), F.lit("-"))))
        .otherwise(F.concat(F.lit("sans "), "p_name"))
    )
    names = b.raw("lineitem").join(b.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_linenumber", "p_name", name.alias("ingredient"))
    found = N.resolve_names(names, N.alias_index(_name_catalogue(b)))
    counts = names.groupBy("ingredient").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(found, counts["ingredient"] == found["name"]).select("ingredient", "n", "key", "id")


@_query
def hyphen_names(b: Bindings) -> DataFrame:
    """Names whose last part behind a hyphen is in the catalogue, as it is or in the plural."""
    names = b.raw("part").select(F.concat(F.initcap("p_type"), F.lit("-"), "p_name", F.when(F.col("p_size") % 2 == 0, "en").otherwise("")).alias("ingredient"))
    return N.resolve_names(names, N.alias_index(_name_catalogue(b)))


@_query
def duration_texts(b: Bindings) -> DataFrame:
    """Durations in German and French, written from prices and dates of the orders, as ISO-8601."""
    hours, minutes = F.floor(F.col("o_totalprice") % 7).cast("int"), F.dayofmonth("o_orderdate")
    shown = (
        F.when(F.col("o_orderpriority").startswith("1"), F.concat(hours.cast("string"), F.lit(" Std. "), minutes.cast("string"), F.lit(" Min.")))
        .when(F.col("o_orderpriority").startswith("2"), F.concat(hours.cast("string"), F.lit(" heures")))
        .when(F.col("o_orderpriority").startswith("3"), F.concat(F.lit("ca. "), minutes.cast("string"), F.lit(" minutes")))
        .otherwise(F.lower("o_orderpriority"))
    )
    return b.raw("orders").select("o_orderkey", D.text_to_iso(shown).alias("iso"))


@_query
def recipe_addresses(b: Bindings) -> DataFrame:
    """Which addresses look like recipe pages of a source, for the paths of all pages under each source's own rule."""
    sources = F.explode(F.array(*[F.lit(s.key) for s in SM.enabled_sources(disabled=("schweizerfleisch",))])).alias("source")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)$", 1)
    pages = b.raw("pages").select("page_id", sources, F.regexp_replace(path, "^/(de|fr)/", "/$1/rezepte/").alias("path"))
    address = F.concat(F.lit("https://www.example.ch"), "path")
    return pages.select("page_id", "source", SM.is_recipe_url(address, F.col("source")).alias("is_recipe"), SM.detect_language(address, F.col("source")).alias("language"))


@_query
def picture_addresses(b: Bindings) -> DataFrame:
    """The first address of a source set, and root-relative addresses with their site."""
    url = F.col("url")
    pages = b.raw("pages").select(
        "page_id", F.concat(url, F.lit(" 1x,"), url, F.lit("-large 2x")).alias("srcset"), F.regexp_extract(url, r"^[a-z]+://[^/]*(/.*)$", 1).alias("path"), "url"
    )
    return pages.select(
        "page_id", U.first_srcset_url(F.col("srcset")).alias("first"), U.absolute_url(F.col("path"), "https://img.example.ch").alias("whole"),
        U.absolute_url(url, "https://img.example.ch").alias("same"),
    )


def _props_pages(b: Bindings) -> DataFrame:
    """Pages whose component props list a group per line of the documents, and an ingredient per sentence."""
    item = lambda x: F.struct(F.struct(
        F.lit("2").alias("amount"), F.struct(F.struct(F.lit("dl").alias("shortForm"), F.lit("Deziliter").alias("name")).alias("entity")).alias("quantity"), x.alias("title")
    ).alias("entity"))
    group = lambda line: F.struct(F.struct(F.col("lang").alias("title"), F.transform(F.split(line, r"\."), item).alias("ingredients")).alias("entity"))
    props = F.to_json(F.struct(F.transform(F.split("text", "\n"), group).alias("ingredientsLists"), F.lit("4").alias("numberOfPersons")))
    escaped = F.replace(F.replace(F.replace(F.replace(props, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(
        F.lit("<html><h1>"), F.col("source"), F.lit('</h1><div data-react-props="{}"></div><div data-react-props="'), escaped,
        F.lit('"></div><section class="ingredients"><ul><li>3 dl anderes</li></ul></section></html>'),
    )
    return b.raw("documents").select("doc_id", F.lit("u").alias("url"), F.col("lang").alias("language"), html.alias("html"))


@_query
def props_records(b: Bindings) -> DataFrame:
    """Records of pages that carry component props: these win over the lists in the markup."""
    raw = PG.from_markup(_props_pages(b))
    items = F.flatten(F.transform("ingredient_groups", lambda g: g["items"]))
    return raw.select(
        "doc_id", "title", "yield_amount", F.size("ingredient_groups").alias("n_groups"), F.size(items).alias("n_items"),
        F.array_join(F.array_distinct(F.transform("ingredient_groups", lambda g: g["label"])), "|").alias("labels"),
        F.sha2(F.array_join(F.transform(items, lambda x: F.regexp_replace(x, r"\s+", "")), "|"), 256).alias("items"),
    )


@_query
def completed_records(b: Bindings) -> DataFrame:
    """Structured records that lack keywords, category, difficulty and captions, completed from their pages; equipment is no food."""
    text = F.regexp_replace("text", "[<>&]", " ")
    html = F.concat(
        F.lit('<html><head><meta name="keywords" content="Schnell, '), F.col("lang"), F.lit('"></head><body><nav class="breadcrumb"><a href="/">Home</a><a>'), F.col("source"),
        F.lit('</a></nav><section class="ingredients"><h4>Teig</h4><ul><li>'), F.substring_index(text, "\n", 1), F.lit("</li></ul></section></body></html>"),
    )
    none = F.array().cast("array<string>")
    given = b.raw("documents").select(
        "doc_id", F.col("source").alias("title"), html.alias("html"), F.concat(F.split(text, "\n"), F.array(F.lit("1 Stück Backpapier"))).alias("ingredients_raw"),
        F.array().cast("array<struct<label:string,items:array<string>>>").alias("ingredient_groups"), F.array("source", "lang").alias("image_urls"),
        F.array("lang").alias("image_captions"), F.when(F.col("lang") == "en", F.array(F.lit("own"))).otherwise(none).alias("keywords"),
        F.lit("").alias("category"), F.lit("italian").alias("cuisine"), F.lit("").alias("difficulty"),
    )
    done = PG.complete_with_markup(given)
    return done.select(
        "doc_id", _joined("keywords"), "category", "cuisine", "difficulty", _joined("image_captions"), F.size("ingredients_raw").alias("n_lines"),
        F.array_join(F.transform("ingredient_groups", lambda g: g["label"]), "|").alias("labels"),
    )


def _stored_folder(b: Bindings) -> str:
    """A data folder with the recipes, their steps and lines, written in two goes; all other tables are seeded empty."""
    folder = f"{ensure_checkpoint_dir(b.spark)}/folder-{uuid.uuid4().hex}"
    recipes = b.recipes().select("id", "title", "language", "source_id", "source_external_id", "total_minutes", "status")
    write_table(recipes.filter("language = 'de'"), folder, "recipes")
    append_table(recipes.filter("language != 'de'"), folder, "recipes")
    write_table(b.recipe_steps(), folder, "recipe_steps")
    write_table(b.recipe_ingredients().select("recipe_id", "seq", "raw_text"), folder, "recipe_ingredients")
    seed_empty_tables(b.spark, folder)
    seed_if_empty(SM.source_rows(b.spark), folder, "sources")
    seed_if_empty(SM.source_rows(b.spark).limit(0), folder, "sources")
    write_fingerprint(b.spark, folder)
    return folder


@_query
def stored_tables(b: Bindings) -> DataFrame:
    """Rows of all tables of a folder, asked through its views."""
    folder = _stored_folder(b)
    for view in (views := register_views(b.spark, folder)):
        assert read_table(b.spark, folder, view).schema == schema_for(view)
    parts = [S.run_query(b.spark, f"select '{v}' as `table`, count(*) as rows from {v}", limit=None, views=views) for v in views]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@_query
def folder_checks(b: Bindings) -> DataFrame:
    """What validation and the doctor say about a folder with some orphans and repeated recipes."""
    folder = _stored_folder(b)
    append_table(b.raw("customer").select((F.col("c_custkey") + 100_000_000).alias("recipe_id"), F.lit(1).alias("step_no"), F.col("c_name").alias("text")), folder, "recipe_steps")
    found = Q.validate(b.spark, folder).groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(Q.doctor(b.spark, folder).groupBy(F.concat_ws(" ", "check", "severity").alias("check")).agg(F.count(F.lit(1)).alias("n")))


# --- pages ----------------------------------------------------------------------------------------------


@_query
def page_titles(b: Bindings) -> DataFrame:
    return b.raw("pages").select("page_id", F.sha2(PG.title(F.col("html")), 256).alias("digest"))


@_query
def page_list_items(b: Bindings) -> DataFrame:
    items = PG.list_items(F.col("html"))
    return b.raw("pages").select("page_id", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


@_query
def page_records(b: Bindings) -> DataFrame:
    pages = b.raw("pages").withColumn("language", SM.detect_language(F.col("url")))
    return PG.from_markup(pages).select(
        "page_id", "language", F.size("ingredients_raw").alias("n_lines"), F.size("steps_raw").alias("n_steps"),
        F.size("keywords").alias("n_keywords"), "category", "cuisine", "error",
    )


@_query
def markup_records(b: Bindings) -> DataFrame:
    """Records read from markup that is written from the documents: one list item and one step per line of text."""
    text = F.regexp_replace("text", "[<>&]", " ")
    items = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("<li><b>"), x, F.lit("</b></li>"))), "")
    step = lambda x, i: F.concat(F.lit('<div class="recipe-step">'), (i + 1).cast("string"), F.lit(" <div><p>"), x, F.lit("</p></div></div>"))
    steps = F.array_join(F.transform(F.split(text, "\n"), step), "")
    html = F.concat(
        F.lit('<html><head><meta name="keywords" content="Thai, '), F.col("lang"), F.lit('"></head><body><nav class="breadcrumb"><a href="/">Home</a><a>'),
        F.col("source"), F.lit("</a></nav><h1> Text &amp; <i>"), F.col("lang"), F.lit('</i></h1><section class="ingredients"><h3>Zutaten</h3><h4>Teil</h4><ul>'),
        items, F.lit("</ul></section>"), steps, F.lit("</body></html>"),
    )
    pages = b.raw("documents").select("doc_id", F.lit("u").alias("url"), F.col("lang").alias("language"), html.alias("html"))
    raw = PG.from_markup(pages)
    return raw.select(
        "doc_id", "title", "category", "cuisine", _joined("keywords"), F.size("steps_raw").alias("n_steps"),
        F.sha2(F.array_join(F.array_sort("steps_raw"), "|"), 256).alias("steps"),
        F.size("ingredients_raw").alias("n_lines"), F.sha2(F.array_join("ingredients_raw", "|"), 256).alias("lines"),
        F.array_join(F.transform("ingredient_groups", lambda g: g["label"]), "|").alias("labels"),
    )


def _structured_pages(b: Bindings) -> DataFrame:
    """Pages that carry a structured recipe, written from the documents: a step per line, the first half of them in a section within a section."""
    plain = lambda x: F.struct(F.lit("HowToStep").alias("@type"), x.alias("text"), none.alias("itemListElement"))
    none = F.lit(None).cast("array<struct<`@type`:string,itemListElement:array<struct<`@type`:string,text:string>>>>")
    rows = F.split("text", "\n")
    half = (F.size(rows) / 2).cast("int")
    inner = F.transform(F.slice(rows, F.lit(1), half), lambda x: F.struct(F.lit("HowToStep").alias("@type"), x.alias("text")))
    section = F.struct(
        F.lit("HowToSection").alias("@type"), F.lit(None).cast("string").alias("text"),
        F.array(F.struct(F.lit("HowToSection").alias("@type"), inner.alias("itemListElement"))).alias("itemListElement"),
    )
    doc = F.to_json(
        F.struct(
            F.lit("Recipe").alias("@type"),
            F.col("source").alias("name"),
            F.split("text", "\n").alias("recipeIngredient"),
            F.concat(F.array(section), F.transform(F.slice(rows, half + 1, F.size(rows)), plain)).alias("recipeInstructions"),
            F.array(F.col("doc_id")).alias("recipeYield"),
            F.concat_ws(", ", "lang", "source", F.lit(" ")).alias("keywords"),
            F.struct(F.concat(F.lit("https://img.example.org/"), F.col("doc_id").cast("string")).alias("url"),
                     F.col("lang").alias("caption")).alias("image"),
        )
    )
    wrapped = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"@graph":['), doc, F.lit(',{"@type":"Person"}]}')))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("["), doc, F.lit("]")))
        .otherwise(doc)
    )
    broken = F.when(F.col("doc_id") % 7 == 0, F.lit("{broken")).otherwise(wrapped)
    script = F.concat(F.lit('<html><script type="application/ld+json">'), broken, F.lit("</script><h1>x</h1></html>"))
    return b.raw("documents").select("doc_id", F.lit("u").alias("url"), F.col("lang").alias("language"), script.alias("html"))


@_query
def structured_records(b: Bindings) -> DataFrame:
    raw = SD.to_raw_records(SD.extract_recipes(_structured_pages(b)))
    return raw.select(
        "doc_id", "title", F.size("ingredients_raw").alias("n_lines"),
        F.sha2(F.array_join("ingredients_raw", "|"), 256).alias("lines"),
        F.size("steps_raw").alias("n_steps"), F.sha2(F.array_join("steps_raw", "|"), 256).alias("steps"), "yield_amount", _joined("keywords"), _joined("image_urls"),
        _joined("image_captions"),
    )


@_query
def sitemap_addresses(b: Bindings) -> DataFrame:
    loc = F.concat(F.lit("<loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    xml = F.when(
        F.col("page_id") % 2 == 0, F.concat(F.lit("<urlset><url>"), loc, F.lit("</url><url><loc> b </loc></url></urlset>"))
    ).otherwise(F.concat(F.lit("<sitemapindex><sitemap>"), loc, F.lit("</sitemap></sitemapindex>")))
    return SM.sitemap_urls(b.raw("pages").select("page_id", xml.alias("xml"))).select("page_id", "position", "url")


# --- ordering, rendering --------------------------------------------------------------------------------


@_query
def assigned_ids(b: Bindings) -> DataFrame:
    rows = b.raw("orders").select("o_orderkey", "o_totalprice")
    return dense_ids(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 1000, "new_id").select("o_orderkey", "new_id")


@_query
def line_ordinals(b: Bindings) -> DataFrame:
    rows = b.raw("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return group_ordinals(rows, ["l_suppkey"], order)


def _dossier_lines(b: Bindings) -> DataFrame:
    recipes = b.recipes().select("id", "title", "servings", "total_minutes", "difficulty", "course", "cuisine", "source_id")
    return M.dossier_lines(recipes, b.recipe_ingredients(), b.recipe_steps())


@_query
def dossier_texts(b: Bindings) -> DataFrame:
    return M.dossier_documents(_dossier_lines(b))


@_query
def dossier_sections(b: Bindings) -> DataFrame:
    """Sections of documents in which every line break that starts a sentence became a header."""
    docs = b.raw("documents").select("doc_id", F.regexp_replace("text", "\n", "\n## ").alias("text"))
    return M.split_sections(docs, "doc_id").select(
        "doc_id", "position", F.sha2("section", 256).alias("section"), F.length("body").alias("body_length")
    )


# --- streaming ------------------------------------------------------------------------------------------


@_query
def windowed_tool_events(b: Bindings) -> DataFrame:
    """Statistics per tool and day, computed by a stream over the event files, which may come in any order."""
    schema = b.raw("events").schema
    raw = event_stream(b.spark, f"{b.folder}/events.parquet*", schema)
    events = raw.selectExpr(
        "event_type as tool",
        # Wall-clock times are UTC, whatever the session's time zone.
        "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', ts)) as started_at",
        "value as duration_ms",
        "event_type <> 'error' as success",
    )
    base = f"{ensure_checkpoint_dir(b.spark)}/tool-events-{uuid.uuid4().hex}"
    start_window_parts(events, f"{base}/parts", f"{base}/progress", "1 day").awaitTermination()
    return read_window_stats(b.spark, f"{base}/parts").select(
        F.date_from_unix_date((F.unix_seconds("window_start") / 86400).cast("int")).cast("string").alias("day"), "tool", "calls", "errors",
        F.round("total_ms", 2).alias("total_ms"), "max_ms",
    )


@_query
def streamed_ingest(b: Bindings) -> DataFrame:
    """Documents streamed in as raw records; one stored record per content."""
    base = f"{ensure_checkpoint_dir(b.spark)}/streamed-{uuid.uuid4().hex}"
    records = _document_records(b)
    records.write.parquet(f"{base}/incoming")
    query = start_ingest(
        record_stream(b.spark, f"{base}/incoming"), f"{base}/stored", f"{base}/progress", ["de", "en", "fr"]
    )
    query.awaitTermination()
    return b.spark.read.parquet(f"{base}/stored").select("source_id", "position", "content_hash")
