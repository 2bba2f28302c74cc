"""Incremental load: decide what is new, build the table rows, soft-delete what vanished, audit the run.

Every record gets a disposition. All decisions over groups (equal URL, equal content) are taken on
map-side combined aggregates and brought back to the records by their unique position, so copies
of one record may make up any share of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import durations as D
from larder.functions.text import any_of, content_hash, normalise_title
from larder.functions.urls import external_id
from larder.operators import classify as C
from larder.operators import resolve as R
from larder.operators.changes import max_id
from larder.operators.tags import TagRows, classification_tags, keyword_tags
from larder.plans.joins import dense_ids, join_dimension, lookup_each
from larder.session import ensure_checkpoint_dir

# Navigation phrases and limits of the line-quality heuristics.
NAVIGATION_PHRASES = ["hauptmenü", "menu schliessen", "jetzt entdecken", "jetzt weiterstöbern", "werbung buchen"]
MAX_MEAN_LENGTH = 150
MIN_DIGIT_SHARE = 0.2
MIN_LINES_FOR_DIGITS = 3

DISPOSITIONS = ["new", "known", "language", "invalid", "duplicate", "error", "over_limit"]


def suspicious_lines(lines: Column) -> Column:
    """Reason why ingredient lines look like navigation text, null when they look fine."""
    n = F.size(lines)
    total = F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.length(x))
    digits = F.size(F.filter(lines, lambda x: x.rlike(r"\d")))
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(total / n > MAX_MEAN_LENGTH, "long lines")
        .when(F.lower(F.array_join(lines, " ")).rlike(any_of(NAVIGATION_PHRASES)), "navigation text")
        .when((n >= MIN_LINES_FOR_DIGITS) & (digits / n < MIN_DIGIT_SHARE), "few quantities")
    )


def with_hash(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "content_hash",
        content_hash(F.col("language"), F.col("title"), F.col("ingredients_raw"), F.col("steps_raw")),
    )


def decide(
    records: DataFrame,
    recipes: DataFrame,
    languages: Sequence[str] | None = None,
    limit_per_source: int | None = None,
) -> DataFrame:
    """``(source_id, position, content_hash, error, disposition)`` of ``records(source_id, position, error, …)``.

    Works on keys and hashes only, so that the texts are not shuffled. ``position`` orders the
    records of a source. With a limit, everything behind the last new record allowed for a source is
    ``over_limit``; run sources one after the other then, if they may share content. Duplicates are
    settled over all given records.
    """
    error = F.col("error") if "error" in records.columns else F.lit(None).cast("string")
    wrong_language = ~F.col("language").isin(list(languages)) if languages else F.lit(False)
    empty = (F.coalesce(F.size("ingredients_raw"), F.lit(0)) < 1) & (F.coalesce(F.size("steps_raw"), F.lit(0)) < 1)
    fault = F.when(error.isNotNull(), "error").when(wrong_language, "language").when(empty, "invalid")
    narrow = with_hash(records).select(
        "source_id", "position", "source_url", "content_hash", error.alias("error"), fault.alias("_fault")
    )
    seen_urls = (
        records.select("source_url")
        .distinct()
        .join(recipes.select("source_url").distinct(), "source_url", "left_semi")
        .withColumn("_seen", F.lit(True))
    )
    checked = (
        narrow.join(seen_urls, "source_url", "left")
        .withColumn("_own", F.when(F.col("_seen"), "known").otherwise(F.col("_fault")))
        .drop("_seen", "_fault")
    )
    # A URL is taken once, by its first record; then a text is.
    by_url = F.coalesce("source_url", F.concat_ws(":", F.lit("#"), "source_id", "position"))
    first = (
        checked.filter("_own is null")
        .groupBy(by_url.alias("url"))
        .agg(F.min(F.struct("source_id", "position", "content_hash")).alias("r"))
        .groupBy("r.content_hash")
        .agg(F.min(F.struct("r.source_id", "r.position")).alias("first"))
    )
    fresh = first.join(
        recipes.select("content_hash").filter("content_hash is not null").distinct(), "content_hash", "left_anti"
    ).select("first.source_id", "first.position", F.lit(True).alias("_new"))
    decided = checked.drop("source_url").join(fresh, ["source_id", "position"], "left").withColumn(
        "disposition", F.coalesce("_own", F.when(F.col("_new"), "new"), F.lit("duplicate"))
    )
    if limit_per_source is not None:
        order = Window.partitionBy("source_id").orderBy("position")
        # Spark cuts each partition to the first rows per source before it ranks them.
        last = (
            fresh.withColumn("_n", F.row_number().over(order))
            .filter(F.col("_n") <= limit_per_source)
            .groupBy("source_id")
            .agg(F.max("_n").alias("_n"), F.max("position").alias("_last"))
            .filter(F.col("_n") == limit_per_source)
            .drop("_n")
        )
        behind = F.col("position") > F.col("_last")
        decided = (
            join_dimension(decided, last, "source_id", "left")
            .withColumn("disposition", F.when(behind, "over_limit").otherwise(F.col("disposition")))
            .drop("_last")
        )
    return decided.select("source_id", "position", "content_hash", "error", "disposition")


def accepted(records: DataFrame, decided: DataFrame) -> DataFrame:
    """Whole records that are new, with their hash; the only step that shuffles the texts."""
    keys = decided.filter("disposition = 'new'").drop("disposition", "error")
    return records.drop("content_hash").join(keys, ["source_id", "position"])


def audit(decided: DataFrame) -> DataFrame:
    """Counters and status per source."""

    def count(*kinds: str) -> Column:
        return F.count_if(F.col("disposition").isin(*kinds))

    counts = decided.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("discovered"),
        count("new").alias("fetched"),
        count("known", "language", "duplicate").alias("skipped"),
        count("error").alias("errors"),
        count("invalid").alias("validation_skipped"),
    )
    status = (
        F.when((F.col("errors") > 0) & (F.col("fetched") == 0), "failed")
        .when(F.col("errors") > 0, "partial")
        .otherwise("success")
    )
    return counts.withColumn("status", status)


def error_summary(decided: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` error texts per source, joined."""
    order = Window.partitionBy("source_id").orderBy("position")
    return (
        decided.filter("disposition = 'error'")
        .select("source_id", "position", "error", F.row_number().over(order).alias("_n"))
        .filter(F.col("_n") <= n)
        .groupBy("source_id")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "error"))).alias("e"))
        .select("source_id", F.array_join(F.transform("e", lambda x: x["error"]), "; ").alias("error_summary"))
    )


def error_rows(decided: DataFrame) -> DataFrame:
    """``(source_id, position, error)`` of every record that failed; the summary names the first ones only."""
    return decided.filter("disposition = 'error'").select("source_id", "position", "error")


def run_rows(
    sources: DataFrame,
    decided: DataFrame,
    started_at: datetime,
    finished_at: datetime,
    *,
    deleted: DataFrame | None = None,
    failures: DataFrame | None = None,
    batch_size: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Final ``etl_runs`` rows without ids: one for each of ``sources(id, key)``, also for those without any record.

    ``deleted(source_id, soft_deleted)``; ``failures(source_id, error)``: sources whose discovery failed. A failed discovery counts as an
    error, its text comes first in the summary, and a source with errors and nothing fetched is ``failed``. Records of unknown sources make no row.
    """
    counts = ["discovered", "fetched", "skipped", "errors", "validation_skipped"]
    known = sources.select(F.col("id").alias("source_id"), F.col("key").alias("source"))
    runs = known.join(audit(decided).drop("status"), "source_id", "left").join(error_summary(decided), "source_id", "left")
    nothing = F.lit(None).cast("string")
    if failures is not None:
        failed = failures.groupBy("source_id").agg(F.count(F.lit(1)).alias("_failures"), F.min("error").alias("_failure"))
        runs = runs.join(failed, "source_id", "left")
        runs = runs.withColumn("errors", F.coalesce("errors", F.lit(0)) + F.coalesce("_failures", F.lit(0)))
        nothing = F.when(F.col("_failure").isNotNull(), F.concat(F.lit("Discovery failed: "), F.col("_failure")))
    runs = runs.withColumn("error_summary", F.nullif(F.concat_ws("; ", nothing, "error_summary"), F.lit("")))
    if deleted is not None:
        runs = runs.join(deleted, "source_id", "left")
    else:
        runs = runs.withColumn("soft_deleted", F.lit(0))
    runs = runs.withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in [*counts, "soft_deleted"]})
    status = (
        F.when((F.col("errors") > 0) & (F.col("fetched") == 0), "failed").when(F.col("errors") > 0, "partial").otherwise("success")
    )
    return runs.select(
        "source_id", "source", *counts, "soft_deleted", "error_summary", status.alias("status"),
        D.utc_literal(started_at).alias("started_at"), D.utc_literal(finished_at).alias("finished_at"),
        F.lit(round((finished_at - started_at).total_seconds(), 2)).alias("duration_seconds"),
        F.lit(batch_size).cast("smallint").alias("batch_size"), F.lit(limit).cast("int").alias("limit"),
    )


def close_interrupted(runs: DataFrame, source: str, finished_at: datetime) -> DataFrame:
    """Mark runs of a source that never finished as crashed."""
    stale = (F.col("source") == source) & (F.col("status") == "running")
    seconds = F.round(
        F.expr("timestampdiff(MICROSECOND, started_at, finished_at)") / F.lit(1e6), 2
    )
    return (
        runs.withColumn("_stale", stale)
        .withColumn("finished_at", F.when(F.col("_stale"), D.utc_literal(finished_at)).otherwise(F.col("finished_at")))
        .withColumn("duration_seconds", F.when(F.col("_stale"), seconds).otherwise(F.col("duration_seconds")))
        .withColumn("status", F.when(F.col("_stale"), "crashed").otherwise(F.col("status")))
        .select(*runs.columns)
    )


def soft_delete(recipes: DataFrame, discovered: DataFrame, *, allow_empty: bool = False) -> DataFrame:
    """Set active recipes to ``deleted`` when their source was discovered without their URL.

    ``discovered(source_id, source_url)`` lists everything found now. Only sources that occur in it
    are touched, so an empty discovery deletes nothing unless ``allow_empty`` is set.
    """
    found = discovered.select("source_id", "source_url").distinct().withColumn("_found", F.lit(True))
    joined = recipes.join(found, ["source_id", "source_url"], "left")
    gone = F.col("_found").isNull() & (F.col("status") == "active")
    if not allow_empty:
        sources = discovered.select("source_id").distinct().withColumn("_ran", F.lit(True))
        joined = join_dimension(joined, sources, "source_id", "left")
        gone = gone & F.col("_ran")
    return joined.select(
        *[
            F.when(gone, "deleted").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c)
            for c in recipes.columns
        ]
    )


def vanished(recipes: DataFrame, discovered: DataFrame) -> DataFrame:
    """``(source_id, soft_deleted)``: how many active recipes of a discovered source were not found; sources without any are left out."""
    found = discovered.select("source_id", "source_url").distinct()
    active = recipes.filter("status = 'active'").select("source_id", "source_url")
    active = join_dimension(active, discovered.select("source_id").distinct(), "source_id", "left_semi")
    return active.join(found, ["source_id", "source_url"], "left_anti").groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("soft_deleted"))


def ingredient_rows(records: DataFrame, index: DataFrame) -> DataFrame:
    """``recipe_ingredients`` rows of new records (``recipe_id, ingredients_raw, ingredient_groups``)."""
    single = F.array(
        F.struct(F.lit(None).cast("string").alias("label"), F.col("ingredients_raw").alias("items"))
    )
    groups = F.when(F.size("ingredient_groups") > 0, F.col("ingredient_groups")).otherwise(single)
    flat = F.flatten(
        F.transform(
            groups,
            lambda g: F.transform(
                g["items"], lambda item: F.struct(g["label"].alias("group_label"), item.alias("raw_text"))
            ),
        )
    )
    lines = records.select("recipe_id", F.posexplode(flat).alias("_pos", "_line")).select(
        "recipe_id", (F.col("_pos") + 1).alias("seq"), "_line.group_label", "_line.raw_text"
    )
    resolved = R.resolve_lines(R.parse_texts(lines).checkpoint(), index)
    return resolved.select(
        "recipe_id",
        "seq",
        "ingredient_id",
        "raw_text",
        "quantity",
        "unit",
        "prep_note",
        "optional",
        "group_label",
    )


def step_rows(records: DataFrame) -> DataFrame:
    return records.select("recipe_id", F.posexplode("steps_raw").alias("_pos", "text")).select(
        "recipe_id", (F.col("_pos") + 1).alias("step_no"), "text", F.lit(None).cast("string").alias("image_url")
    )


def image_rows(records: DataFrame) -> DataFrame:
    """``recipe_images`` rows; captions (and ``local_paths`` if present) run parallel to the URLs."""
    path = (
        F.get(F.col("local_paths"), F.col("_pos")) if "local_paths" in records.columns else F.lit(None).cast("string")
    )
    return records.select("*", F.posexplode("image_urls").alias("_pos", "url")).select(
        "recipe_id",
        (F.col("_pos") + 1).alias("seq"),
        "url",
        path.alias("local_path"),
        F.get(F.col("image_captions"), F.col("_pos")).alias("caption"),
    )


def _adding(**columns: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda texts: texts.withColumns(columns)


def recipe_rows(records: DataFrame, lines: DataFrame, catalogue: DataFrame, now: datetime) -> DataFrame:
    """``recipes`` rows of new records with all classification columns."""
    empty = F.array().cast("array<string>")
    staged = records.withColumn("keywords", F.coalesce("keywords", empty)).withColumns(
        {"_words": F.array_join("keywords", " "), "_method_text": C.method_text(F.col("steps_raw"), F.col("keywords"))}
    )
    # what follows from one text alone is computed once per distinct text, where texts repeat
    staged = lookup_each(
        staged,
        {
            "prep_time": _adding(_p=D.duration_minutes(F.col("prep_time"))),
            "cook_time": _adding(_c=D.duration_minutes(F.col("cook_time"))),
            "total_time": _adding(_t=D.duration_minutes(F.col("total_time"))),
            "title": _adding(
                title_normalised=normalise_title(F.col("title")), _title_course=C.title_course(F.col("title")), _title_cuisine=C.named_cuisine(F.col("title"))
            ),
            "_words": _adding(_words_cuisine=C.named_cuisine(F.col("_words"))),
            "_method_text": _adding(cooking_method=C.method_of(F.col("_method_text"))),
        },
    )
    times = D.reconcile_times(F.col("_p"), F.col("_c"), F.col("_t"))
    raw_lines = F.when(
        F.size("ingredient_groups") > 0, F.flatten(F.transform("ingredient_groups", lambda g: g["items"]))
    ).otherwise(F.coalesce("ingredients_raw", empty))
    cuisine = C.cuisine(
        F.col("cuisine"), F.col("title"), F.col("keywords"), F.col("source_url"), raw_lines, F.col("_title_cuisine"), F.col("_words_cuisine")
    )
    staged = (
        staged.withColumn("prep_minutes", times.prep)
        .withColumn("cook_minutes", times.cook)
        .withColumn("total_minutes", times.total)
        .withColumn("course", C.course(F.col("category"), F.col("title"), F.col("keywords"), F.col("_title_course")))
        .withColumn("cuisine", cuisine)
        .withColumn("difficulty", C.difficulty(F.col("difficulty"), F.col("total_minutes")))
    )
    classified = C.classify_parts(staged, lines, catalogue)
    return classified.select(
        F.col("recipe_id").alias("id"),
        "source_id",
        external_id(F.col("source_url"), F.col("language")).alias("source_external_id"),
        "source_url",
        "title",
        "title_normalised",
        "language",
        "description",
        D.servings(F.col("yield_amount")).alias("servings"),
        "prep_minutes",
        "cook_minutes",
        "total_minutes",
        "difficulty",
        "cuisine",
        "course",
        F.get(F.col("image_urls"), 0).alias("primary_image_url"),
        F.col("keywords").alias("original_keywords"),
        F.lit(None).cast("tinyint").alias("owner_rating"),
        F.lit(False).alias("starred"),
        F.lit(0).alias("times_cooked"),
        F.lit(None).cast("timestamp_ntz").alias("last_cooked_at"),
        D.utc_literal(now).alias("scraped_at"),
        D.utc_literal(now).alias("updated_at"),
        "content_hash",
        F.lit("active").alias("status"),
        "primary_protein",
        "taste_profile",
        "weight_class",
        "cooking_method",
        "dietary_flags",
        "food_groups",
    )


class IngestRows:
    """Rows to append for a batch. The lines, recipes and tags are computed when they are first asked for, and once."""

    def __init__(self, decided: DataFrame, taken: DataFrame, tags: DataFrame, catalogue: DataFrame, now: datetime):
        self.decided, self._taken, self._known_tags, self._catalogue, self._now = decided, taken, tags, catalogue, now
        self.recipe_steps = step_rows(taken)
        self.recipe_images = image_rows(taken)
        self.audit = audit(decided)

    @cached_property
    def recipe_ingredients(self) -> DataFrame:
        return ingredient_rows(self._taken, R.alias_index(self._catalogue)).checkpoint()

    @cached_property
    def recipes(self) -> DataFrame:
        return recipe_rows(self._taken, self.recipe_ingredients, self._catalogue, self._now).checkpoint()

    @cached_property
    def _tag_rows(self) -> tuple[TagRows, TagRows]:
        from_keywords = keyword_tags(self._taken.select("recipe_id", "keywords"), self._known_tags)
        known = self._known_tags.select("id", "key", "display", "facet").unionByName(from_keywords.tags)
        return from_keywords, classification_tags(self.recipes, known)

    @property
    def tags(self) -> DataFrame:
        from_keywords, from_classes = self._tag_rows
        return from_keywords.tags.unionByName(from_classes.tags)

    @property
    def recipe_tags(self) -> DataFrame:
        from_keywords, from_classes = self._tag_rows
        return from_keywords.links.unionByName(from_classes.links)


def ingest(
    records: DataFrame,
    recipes: DataFrame,
    tags: DataFrame,
    catalogue: DataFrame,
    now: datetime,
    *,
    languages: Sequence[str] | None = None,
    limit_per_source: int | None = None,
    keep_decided: Callable[[DataFrame], DataFrame] = lambda decided: decided.checkpoint(),
) -> IngestRows:
    """Rows to append for a batch of raw records, and what became of every record.

    ``keep_decided`` materialises the decisions, which feed several branches; a run writes them to its folder.
    """
    ensure_checkpoint_dir(records.sparkSession)
    decided = keep_decided(decide(records, recipes, languages, limit_per_source))
    ids = dense_ids(
        decided.filter("disposition = 'new'").select("source_id", "position"),
        [F.col("source_id"), F.col("position")],
        max_id(recipes) + 1,
        "recipe_id",
    )
    # The accepted records, with their ids, are materialised once and feed all tables.
    taken = accepted(records, decided).join(ids, ["source_id", "position"]).checkpoint()
    return IngestRows(decided, taken, tags, catalogue, now)
