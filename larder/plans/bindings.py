"""Bindings of a star schema (orders, lineitem, part, events, …) to the recipe tables.

They let every operator run on sales-like tables: an order is a recipe, its line items are the
ingredient lines, parts are the catalogue, suppliers are retailers and events are the cook log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import normalise_title
from larder.plans.joins import join_dimension

PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


class Bindings:
    """Lazy recipe-shaped frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        if table not in self._raw:
            self._raw[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._raw[table]

    def recipes(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as id",
            "cast(o_custkey % 5 + 1 as int) as source_id",
            "cast(o_custkey as string) as source_external_id",
            "concat('https://shop.example.org/de/rezepte/', o_orderkey) as source_url",
            "concat('Plat ', cast(o_custkey % 97 as string), ' préparé ', lower(substring(o_orderpriority, 3))) as title",
            "case o_custkey % 3 when 0 then 'de' when 1 then 'fr' else 'it' end as language",
            "cast(o_custkey % 8 + 1 as int) as servings",
            "cast(5 + o_orderkey % 90 as int) as total_minutes",
            "case when 5 + o_orderkey % 90 <= 30 then 'easy' when 5 + o_orderkey % 90 <= 60 then 'medium'"
            " else 'advanced' end as difficulty",
            "case o_custkey % 4 when 0 then 'swiss' when 1 then 'italian' when 2 then '' end as cuisine",
            "case o_custkey % 5 when 0 then 'main' when 1 then 'starter' when 2 then 'dessert' when 3 then 'side' end"
            " as course",
            "cast(6 - cast(substring(o_orderpriority, 1, 1) as int) as int) as owner_rating",
            "o_totalprice > 400000 as starred",
            "cast(o_custkey % 7 as int) as times_cooked",
            "case when o_orderstatus <> 'P' or o_custkey % 2 = 0 then cast(o_orderdate as timestamp_ntz) end"
            " as last_cooked_at",
            "case o_orderstatus when 'O' then 'active' when 'F' then 'deleted' else 'draft' end as status",
            "case when o_totalprice > 250000 then 'beef' end as primary_protein",
            "'savoury' as taste_profile",
            "case when o_totalprice > 300000 then 'heavy' else 'light' end as weight_class",
            "cast(null as string) as cooking_method",
            "case when o_custkey % 2 = 0 then array('vegan', 'quick') end as dietary_flags",
            "case when o_custkey % 3 = 0 then array('nut', 'light') end as food_groups",
        ).withColumn("title_normalised", normalise_title(F.col("title")))

    def recipe_ingredients(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey as recipe_id",
            "l_linenumber as seq",
            "case when l_returnflag <> 'R' then l_partkey end as ingredient_id",
            "concat('Part ', cast(l_partkey % 50 as string)) as raw_text",
            "l_quantity as quantity",
            "case when l_linestatus = 'F' then 'g' else 'ml' end as unit",
            "case when l_tax > 0.05 then 'gehackt' end as prep_note",
            "l_tax = 0.08 as optional",
            "case when l_linenumber <= 3 then 'Teig' when l_linenumber <= 5 then 'Sauce' end as group_label",
        )

    def recipe_steps(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as recipe_id",
            "posexplode(array(concat('Mix for ', cast(o_custkey % 9 as string), ' min.'), 'Serve.')) as (pos, text)",
        ).selectExpr("recipe_id", "pos + 1 as step_no", "text")

    def ingredients(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey as id",
            "concat(replace(p_name, ' ', '-'), '-', cast(p_partkey as string)) as key",
            "p_name as display_de",
            "lower(p_type) as category",
            "p_brand as sub_category",
            "array(lower(p_type), substring_index(p_name, ' ', 1)) as pairing_tags",
        )

    def pantry(self) -> DataFrame:
        return self.raw("part").filter("p_size <= 20").selectExpr(
            "p_partkey as ingredient_id",
            "cast(p_size as double) as approx_quantity",
            "case when p_size % 2 = 0 then 'g' else 'ml' end as unit",
            "case when p_size <= 10 then 'fridge' else 'pantry' end as location",
            "timestamp_ntz '2024-01-01 00:00:00' as updated_at",
            "cast(null as string) as note",
        )

    def cook_log(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id as id",
            "user_id as recipe_id",
            "cast(ts as date) as cooked_on",
            "cast(floor(value) % 6 + 1 as int) as servings",
            "cast(1.0 as double) as scale_factor",
            "case when event_type = 'purchase' then cast(floor(value) % 5 + 1 as int) end as rating",
            "event_type as notes",
            "cast(ts as timestamp_ntz) as logged_at",
        )

    def tags(self) -> DataFrame:
        ids = F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col("p_type"))
        return self.raw("part").select("p_type").distinct().select(
            ids.cast("int").alias("id"), F.lower("p_type").alias("key"), F.col("p_type").alias("display"),
            F.lit("free").alias("facet"),
        )

    def recipe_tags(self) -> DataFrame:
        ids = F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col("p_type"))
        types = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), ids.cast("int").alias("tag_id"))
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("recipe_id"), "l_partkey")
        return join_dimension(lines, types, "l_partkey").select("recipe_id", "tag_id").distinct()

    def retailers(self) -> DataFrame:
        return self.raw("supplier").selectExpr("s_suppkey as id", "s_name as key", "s_name as display_name")

    def promotions(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey as id",
            "l_suppkey as retailer_id",
            "concat('Item ', cast(l_partkey % 100 as string)) as product_name",
            "l_returnflag as brand",
            "l_extendedprice * (1 - l_discount) as price_chf",
            "l_extendedprice as regular_price_chf",
            "100 * l_discount as discount_pct",
            "cast(l_shipdate as date) as valid_from",
            "date_add(cast(l_shipdate as date), 14) as valid_to",
            "l_partkey as ingredient_id",
        )

    def tool_events(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id",
            "event_type as tool",
            "cast(ts as timestamp) as started_at",
            "value as duration_ms",
            "event_type <> 'error' as success",
            "case when event_type = 'error' then props end as error",
        )
