"""Text dossiers: rendering recipes to lines and documents, splitting texts into sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import strip
from larder.plans.joins import fits_broadcast, join_dimension

# Section names and header labels in output order.
SECTIONS = ["title", "description", "metadata", "source", "ingredients", "steps", "notes", "cook log"]
METADATA_FIELDS = [
    ("Source", "source_url"),
    ("Servings", "servings"),
    ("Total time", "total_minutes"),
    ("Difficulty", "difficulty"),
    ("Course", "course"),
    ("Cuisine", "cuisine"),
    ("Language", "language"),
]
SOURCE_FIELDS = [("URL", "source_url"), ("External ID", "source_external_id"), ("Source ID", "source_id")]
SECTION_HEADER = r"(?m)^##\s+(.+)$"
#: Lines of a recipe that are compared with each other in one task.
CHUNK_LINES = 4_096
#: About so many lines are gathered to texts by one task, however large the input is.
LINES_PER_TASK = 500_000
#: Lines whose labels one task sorts.
LABELS_PER_TASK = 150_000


def _field_line(df: DataFrame, label: str, column: str):
    value = F.col(column).cast("string") if column in df.columns else F.lit(None).cast("string")
    suffix = " min" if column == "total_minutes" else ""
    shown = value.isNotNull() & (F.trim(value) != "")
    return F.when(shown, F.concat(F.lit(f"- **{label}:** "), value, F.lit(suffix)))


def _header_lines(recipes: DataFrame) -> DataFrame:
    title = F.coalesce("title", F.lit("Untitled Recipe"))
    description = strip(F.col("description")) if "description" in recipes.columns else F.lit(None).cast("string")
    groups = [
        (0, F.array(F.concat(F.lit("# "), title))),
        (1, F.array_compact(F.array(F.nullif(description, F.lit(""))))),
        (2, F.array_compact(F.array(F.lit("## Metadata"), F.lit(""), *[_field_line(recipes, *f) for f in METADATA_FIELDS]))),
        (3, F.array_compact(F.array(F.lit("## Source"), F.lit(""), *[_field_line(recipes, *f) for f in SOURCE_FIELDS]))),
        (6, F.array(F.lit("## Notes"), F.lit(""))),
        (7, F.array(F.lit("## Cook log"), F.lit(""), F.lit(""))),
    ]
    sections = F.array(*[F.struct(F.lit(n).alias("section"), lines.alias("lines")) for n, lines in groups])
    return (
        recipes.select(F.col("id").alias("recipe_id"), F.explode(sections).alias("s"))
        .select("recipe_id", "s.section", F.posexplode("s.lines").alias("seq", "line"))
        .select("recipe_id", "section", F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("sub"), "line")
    )


def _ingredient_text():
    amount = F.concat_ws(" ", F.col("quantity").cast("string"), F.nullif("unit", F.lit("")))
    base = F.coalesce(F.nullif("raw_text", F.lit("")), F.nullif(amount, F.lit("")), F.lit("?"))
    note = F.nullif("prep_note", F.lit(""))
    with_note = F.when(note.isNotNull() & ~F.contains(base, note), F.concat(base, F.lit(", "), note)).otherwise(base)
    optional = F.when(F.coalesce("optional", F.lit(False)), F.lit(" *(optional)*")).otherwise("")
    return F.concat(F.lit("- "), with_note, optional)


def dossier_lines(recipes: DataFrame, recipe_ingredients: DataFrame, recipe_steps: DataFrame) -> DataFrame:
    """``(recipe_id, section, seq, sub, line)``: every line of every dossier, sortable by those columns.

    A group label becomes a bold line wherever it changes. Lines are compared with their predecessor in chunks of a recipe, and the
    first of a chunk with the last of the chunk before, so no task needs a whole recipe and nothing is sorted as a whole.
    """
    labelled = recipe_ingredients.filter("group_label is not null and group_label != ''").select(
        "recipe_id", "seq", F.col("group_label").alias("label"), F.expr(f"seq div {CHUNK_LINES}").alias("chunk")
    )
    # as many tasks as lines ask for: adaptive execution would join them by their compressed bytes, of which labels have few
    tasks = max(labelled.sparkSession.sparkContext.defaultParallelism, recipe_ingredients.count() // LABELS_PER_TASK + 1)
    labelled = labelled.repartition(tasks, "recipe_id", "chunk")
    within = Window.partitionBy("recipe_id", "chunk").orderBy("seq", "label")
    labelled = labelled.withColumn("n", F.row_number().over(within)).withColumn("previous", F.lag("label").over(within))
    ends = labelled.groupBy("recipe_id", "chunk").agg(F.max_by("label", F.struct("seq", "label")).alias("last"))
    chunks = Window.partitionBy("recipe_id").orderBy("chunk")
    # a row per chunk; only those behind another one are joined
    carried = ends.withColumn("carried", F.lag("last").over(chunks)).filter("carried is not null").select("recipe_id", "chunk", "carried")
    first = labelled.filter("n = 1").join(carried, ["recipe_id", "chunk"], "left").withColumn("before", F.col("carried")).drop("carried")
    others = labelled.filter("n > 1").withColumn("before", F.col("previous"))
    heads = (
        first.unionByName(others)
        .filter("before is null or before != label")
        .select(
            "recipe_id",
            F.lit(4).alias("section"),
            (F.col("seq") + 1).cast("bigint").alias("seq"),
            F.concat(F.lit("**"), F.col("label"), F.lit("**")).alias("label"),
            F.explode(
                F.when(F.col("before").isNull(), F.array(F.lit(-2), F.lit(-1))).otherwise(
                    F.array(F.lit(-3), F.lit(-2), F.lit(-1))
                )
            ).alias("sub"),
        )
        .select(
            "recipe_id", "section", "seq", "sub", F.when(F.col("sub") == -2, F.col("label")).otherwise("").alias("line")
        )
    )
    items = recipe_ingredients.select(
        "recipe_id",
        F.lit(4).alias("section"),
        (F.col("seq") + 1).cast("bigint").alias("seq"),
        F.lit(0).alias("sub"),
        _ingredient_text().alias("line"),
    )
    steps = recipe_steps.select(
        "recipe_id",
        F.lit(5).alias("section"),
        (F.col("step_no") + 1).cast("bigint").alias("seq"),
        F.lit(0).alias("sub"),
        F.concat(F.col("step_no").cast("string"), F.lit(". "), F.col("text")).alias("line"),
    )

    def opening(child: DataFrame, section: int, name: str) -> DataFrame:
        return (
            child.select("recipe_id")
            .distinct()
            .select("recipe_id", F.posexplode(F.array(F.lit(name), F.lit(""))).alias("seq", "line"))
            .select(
                "recipe_id",
                F.lit(section).alias("section"),
                F.col("seq").cast("bigint").alias("seq"),
                F.lit(0).alias("sub"),
                "line",
            )
        )

    parts = [
        items,
        heads,
        opening(recipe_ingredients, 4, "## Ingredients"),
        steps,
        opening(recipe_steps, 5, "## Steps"),
    ]
    known = recipes.select(F.col("id").alias("recipe_id"))
    children = parts[0]
    for part in parts[1:]:
        children = children.unionByName(part)
    # Children of unknown recipes have no dossier. Otherwise than by join_dimension they are computed once; adaptive execution splits hot recipes.
    beside = F.broadcast(known) if fits_broadcast(known) else known
    return _header_lines(recipes).unionByName(children.join(beside, "recipe_id", "left_semi"))


def dossier_documents(lines: DataFrame, lines_per_part: int = 5_000) -> DataFrame:
    """``(recipe_id, part, text)``: dossiers as text, sections apart by an empty line.

    A dossier longer than ``lines_per_part`` continues in further parts (joining the parts with a line break gives the whole text), so
    no row and no task has to hold a huge recipe. Where a part begins follows from counts of lines per section and run of ``seq``:
    a part is about that long, and the lines are shuffled once and not sorted as a whole. A dossier begins in section 0.
    """
    chunk = F.expr(f"seq div {int(lines_per_part)}").alias("chunk")
    sizes = lines.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("total"))
    total, longest = sizes.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.max("total"), F.lit(0))).first()
    if longest <= lines_per_part:
        dealt = lines.withColumn("part", F.lit(0).cast("long"))
    else:
        # rows for the chunks of long dossiers only; all other dossiers are one part
        whole = sizes.filter(F.col("total") > lines_per_part)
        counts = join_dimension(lines, whole.select("recipe_id"), "recipe_id", "left_semi").groupBy("recipe_id", "section", chunk).agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("recipe_id").orderBy("section", "chunk").rowsBetween(Window.unboundedPreceding, -1)
        part = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / lines_per_part).cast("long")
        placed = counts.select("recipe_id", "section", "chunk", part.alias("part"))
        dealt = join_dimension(lines.withColumn("chunk", chunk), placed, ["recipe_id", "section", "chunk"], "left")
        dealt = dealt.withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    # Dealt before they are gathered: a task that reads recipes writes out many lines of each, and would sort all of them to gather its own ones.
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, total // LINES_PER_TASK + 1)
    dealt = dealt.select("recipe_id", "part", "section", "seq", "sub", "line").repartition(tasks, "recipe_id", "part")

    def piece(x: Column) -> Column:
        # The first line of a section has seq 0; an empty line sets it apart from what is before it.
        return F.when((x["seq"] == 0) & (x["section"] > 0), F.concat(F.lit("\n"), x["line"])).otherwise(x["line"])

    return (
        dealt.groupBy("recipe_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("section", "seq", "sub", "line"))).alias("p"))
        .select("recipe_id", "part", F.array_join(F.transform("p", piece), "\n").alias("text"))
    )


def split_sections(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, position, section, body)`` for every ``## name`` section of a text."""
    chunks = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n##[ \t]+")
    return (
        documents.select(key, F.posexplode(chunks).alias("position", "chunk"))
        .filter("position > 0")
        .select(
            key,
            "position",
            strip(F.split("chunk", "\n", 2)[0]).alias("section"),
            F.coalesce(F.get(F.split("chunk", "\n", 2), 1), F.lit("")).alias("body"),
        )
    )


def section(documents: DataFrame, key: str, name: str, text: str = "text") -> DataFrame:
    """Body of the first section with the given name (any case) per text."""
    wanted = split_sections(documents, key, text).filter(F.lower("section") == name.strip().lower())
    first = Window.partitionBy(key).orderBy("position")
    return wanted.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
