"""Table registry: the fifteen tables and their column types."""

from __future__ import annotations

import hashlib

from pyspark.sql import types as T

from larder.errors import UnknownTableError

# Table and column names and their types (column order is part of the contract).
_DDL: dict[str, str] = {
    "sources": "id int, key string, display_name string, base_url string, language string, kind string",
    "recipes": (
        "id int, source_id int, source_external_id string, source_url string, title string, "
        "title_normalised string, language string, description string, servings smallint, "
        "prep_minutes smallint, cook_minutes smallint, total_minutes smallint, difficulty string, "
        "cuisine string, course string, primary_image_url string, original_keywords array<string>, "
        "owner_rating tinyint, starred boolean, times_cooked int, last_cooked_at timestamp_ntz, "
        "scraped_at timestamp_ntz, updated_at timestamp_ntz, content_hash string, status string, "
        "primary_protein string, taste_profile string, weight_class string, cooking_method string, "
        "dietary_flags array<string>, food_groups array<string>"
    ),
    "recipe_steps": "recipe_id int, step_no smallint, text string, image_url string",
    "recipe_images": "recipe_id int, seq smallint, url string, local_path string, caption string",
    "ingredients": (
        "id int, key string, display_de string, display_fr string, display_it string, display_en string, "
        "category string, sub_category string, default_unit string, density_g_per_ml double, "
        "pairing_tags array<string>, aliases array<string>"
    ),
    "recipe_ingredients": (
        "recipe_id int, seq smallint, ingredient_id int, raw_text string, quantity double, unit string, "
        "prep_note string, optional boolean, group_label string"
    ),
    "tags": "id int, key string, display string, facet string",
    "recipe_tags": "recipe_id int, tag_id int",
    "cook_log": (
        "id bigint, recipe_id int, cooked_on date, servings smallint, scale_factor double, rating tinyint, "
        "notes string, logged_at timestamp_ntz"
    ),
    "pantry": (
        "ingredient_id int, approx_quantity double, unit string, location string, updated_at timestamp_ntz, "
        "note string"
    ),
    "retailers": "id int, key string, display_name string, base_url string",
    "promotions": (
        "id bigint, retailer_id int, product_name string, brand string, pack_size string, pack_quantity double, "
        "pack_unit string, price_chf double, regular_price_chf double, discount_pct double, valid_from date, "
        "valid_to date, source_url string, scraped_at timestamp_ntz"
    ),
    "promotion_ingredient_map": (
        "promotion_id bigint, ingredient_id int, confidence float, match_method string, reviewed boolean"
    ),
    "pinned_recipes": (
        "id int, recipe_id int, pinned_at timestamp_ntz, target_date date, note string, status string"
    ),
    "etl_runs": (
        "id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, duration_seconds double, source string, "
        "discovered int, fetched int, skipped int, errors int, soft_deleted int, validation_skipped int, "
        "batch_size smallint, `limit` int, error_summary string, status string"
    ),
}

_TYPES: dict[str, T.DataType] = {
    "tinyint": T.ByteType(),
    "smallint": T.ShortType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    pairs = (column.strip().split(" ") for column in columns.split(","))
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {name: _struct(columns) for name, columns in _DDL.items()}

INGREDIENT_GROUPS = T.ArrayType(
    T.StructType([T.StructField("label", T.StringType()), T.StructField("items", _TYPES["array<string>"])])
)

# Raw records as page sources deliver them, before ids are assigned.
RAW_RECIPE = T.StructType(
    [
        T.StructField(name, INGREDIENT_GROUPS if name == "ingredient_groups" else _TYPES[kind])
        for name, kind in (
            ("title", "string"),
            ("description", "string"),
            ("ingredients_raw", "array<string>"),
            ("ingredient_groups", "groups"),
            ("steps_raw", "array<string>"),
            ("yield_amount", "string"),
            ("prep_time", "string"),
            ("cook_time", "string"),
            ("total_time", "string"),
            ("image_urls", "array<string>"),
            ("image_captions", "array<string>"),
            ("keywords", "array<string>"),
            ("source_url", "string"),
            ("language", "string"),
            ("category", "string"),
            ("cuisine", "string"),
            ("difficulty", "string"),
        )
    ]
)

RAW_PROMOTION = _struct(
    "retailer string, product_name string, original_price double, discounted_price double, discount_pct double, "
    "valid_from date, valid_until date, category string, source_url string, image_url string"
)


def schema_for(table: str) -> T.StructType:
    """Registered schema, or UnknownTableError."""
    try:
        return SCHEMAS[table]
    except KeyError:
        raise UnknownTableError(f"unknown table {table!r}; known: {', '.join(sorted(SCHEMAS))}") from None


def registry_fingerprint() -> str:
    """Short stable fingerprint of every registered column and type."""
    parts = sorted(
        f"{table}.{field.name}:{field.dataType.simpleString()}"
        for table, schema in SCHEMAS.items()
        for field in schema.fields
    )
    return hashlib.sha256("|".join(parts).encode("utf-8")).hexdigest()[:16]
