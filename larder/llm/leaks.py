"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every window of ten words one five-word gram, the one with the smallest hash, is its fingerprint. Two texts that share ten words
share all grams of these words and so the fingerprint, wherever else they differ. Grams of the dossiers are first
held against a bit field of the benchmark's fingerprints: its size has an upper bound, so it can go to every task as a literal, and a fingerprint
is never missed, only let through in vain. What passes is joined with the fingerprints, extended to the windows around it
and joined with the windows of the items. Dossiers are read once, where they lie; only what passes is shuffled.

Items of fewer than ten words are one window. Their fingerprint is their smallest gram of five words (or of all their words, if
fewer), and every gram of a dossier counts as a fingerprint for them, so they are not missed either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import let
from larder.session import ensure_checkpoint_dir

WINDOW = 10
GRAM = 5
#: Bits of the field: sixteen for each fingerprint, but not more than this (512 KB).
MAX_FIELD_BITS = 1 << 22
#: Benchmark rows up to which they are broadcast; beyond, both sides of a join are shuffled.
MAX_BROADCAST_ROWS = 100_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text: digits, letters and all characters beyond ASCII, with A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), 0)


def mark_leaks(dossiers: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Find the words of each dossier that repeat ``window`` words of a benchmark item.

    ``dossiers``: ``recipe_id`` and ``text``; ``benchmark``: ``item_id`` and ``text``; other columns are ignored. A window is ``window``
    consecutive words of an item; an item of fewer words, but not none, is one window. Items without an id are left out; rows of
    one id count as one item.

    Returns one row per input row: ``recipe_id``, ``n_words``, ``n_hit`` (words inside an occurrence of a window),
    ``item_ids`` (of the windows that occur, as strings, sorted), ``spans`` (``start`` and ``size`` in words of each occurrence) and
    ``contaminated``. A null or empty text has no words. Repeated rows are marked alike.
    """
    spark = dossiers.sparkSession
    windows = _item_windows(benchmark, window, gram)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/leaks-{uuid.uuid4().hex}"
    windows.write.parquet(f"{folder}/windows")
    windows = spark.read.parquet(f"{folder}/windows")
    # at most one row for each length up to the window's, and at most MAX_FIELD_BITS / 64 for the field
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    small = windows.count() <= MAX_BROADCAST_ROWS
    field = _bit_field(windows)

    key = [F.col("recipe_id").cast("long").alias("recipe_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")]
    found = let(words_of(F.col("text").cast("string")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _passing(w, sizes, field, window, gram).alias("grams")
    ))
    dossiers.select(*key, found.alias("found")).select("recipe_id", "text_hash", "found.*").write.parquet(f"{folder}/scanned")
    scanned = spark.read.parquet(f"{folder}/scanned")

    grams = scanned.select("recipe_id", "text_hash", F.explode("grams").alias("g")).select("recipe_id", "text_hash", "g.*").distinct()
    prints = windows.select("size", "gram").distinct()
    hits = grams.join(F.broadcast(prints) if small else prints, ["size", "gram"], "left_semi")
    # extend: the windows of which this gram may be the fingerprint
    around = hits.select("recipe_id", "text_hash", "size", F.explode("windows").alias("w")).select(
        "recipe_id", "text_hash", "size", F.col("w.start").alias("start"), F.col("w.words").alias("words")
    )
    texts = windows.select("size", "words").distinct()
    placed = around.distinct().join(F.broadcast(texts) if small else texts, ["size", "words"], "left_semi")
    span = F.struct("start", "size")
    by_place = placed.select("recipe_id", "text_hash", span.alias("span")).distinct()
    by_place = by_place.groupBy("recipe_id", "text_hash").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    items = windows.select("size", "words", "item_id").distinct()
    by_item = placed.select("recipe_id", "text_hash", "size", "words").distinct()
    by_item = by_item.join(F.broadcast(items) if small else items, ["size", "words"]).select("recipe_id", "text_hash", "item_id").distinct()
    by_item = by_item.groupBy("recipe_id", "text_hash").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))

    marks = by_place.join(by_item, _same(by_place, by_item)).select(by_place["*"], by_item["item_ids"])
    none = F.array().cast("array<string>")
    rows = scanned.select("recipe_id", "text_hash", "n_words")
    return rows.join(marks, _same(rows, marks), "left").select(
        rows["recipe_id"],
        rows["n_words"],
        F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["recipe_id"].eqNullSafe(b["recipe_id"]) & (a["text_hash"] == b["text_hash"])


def _gram_hash(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from place ``at`` (from 1) on."""
    return F.xxhash64(*[F.get(words, at - 1 + k) for k in range(size)])


def _item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """``(item_id, size, words, gram)``: the windows of the items with their fingerprints."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("w"))
    items = items.filter(F.col("item_id").isNotNull() & (F.size("w") > 0))
    size = F.least(F.size("w"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    cut = items.select("item_id", size.alias("size"), "w", starts.alias("start")).select(
        "item_id", "size", F.slice("w", F.col("start"), F.col("size")).alias("w")
    )
    smallest = F.lit(None).cast("long")
    for n in range(1, window + 1):
        k = min(n, gram)
        hashes = F.array(*[_gram_hash(F.col("w"), F.lit(s), k) for s in range(1, n - k + 2)])
        smallest = F.when(F.col("size") == n, F.array_min(hashes)).otherwise(smallest)
    return cut.select("item_id", "size", F.array_join("w", " ").alias("words"), smallest.alias("gram")).distinct()


def _bit_field(windows: DataFrame) -> tuple[Column, int]:
    """Two bits for each fingerprint, as a literal array of 64-bit numbers."""
    grams = windows.select("gram").distinct()
    bits = min(MAX_FIELD_BITS, max(1 << 10, 1 << (16 * grams.count()).bit_length()))
    at = F.explode(F.array(F.pmod("gram", F.lit(bits)), F.pmod(F.shiftright("gram", 24), F.lit(bits))))
    places = grams.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("n"))
    rows = places.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("word")).collect()
    field = [0] * (bits // 64)
    for row in rows:
        field[row["n"]] = row["word"]
    return F.split(F.lit(",".join(map(str, field))), ",").cast("array<bigint>"), bits


def _passing(words: Column, sizes: list[int], field: tuple[Column, int], window: int, gram: int) -> Column:
    """Fingerprints of a text that pass the field: ``size`` of the windows, ``gram``, and the windows around it."""
    bits_of, bits = field

    def set_at(place: Column) -> Column:
        return F.getbit(F.get(bits_of, F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1

    def passes(at: Column, k: int) -> Column:
        return let(
            _gram_hash(words, at, k),
            lambda g: set_at(F.pmod(g, F.lit(bits))) & set_at(F.pmod(F.shiftright(g, 24), F.lit(bits))),
        )

    def chosen(at: Column, n: int, k: int) -> Column:
        """No smaller gram in some window of ``n`` words around this one, or ``n`` is below the window."""
        if n < window:
            return F.lit(True)
        windows = F.sequence(F.greatest(F.lit(1), at - (n - k)), F.least(at, F.size(words) - n + 1))
        least = lambda s: F.array_min(F.transform(F.sequence(s, s + (n - k)), lambda p: _gram_hash(words, p, k)))
        return F.exists(windows, lambda s: least(s) == _gram_hash(words, at, k))

    def row(at: Column, n: int, k: int) -> Column:
        starts = F.sequence(F.greatest(F.lit(1), at - (n - k)), F.least(at, F.size(words) - n + 1))
        around = F.transform(
            starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(words, s, F.lit(n)), " ").alias("words"))
        )
        return F.struct(F.lit(n).alias("size"), _gram_hash(words, at, k).alias("gram"), around.alias("windows"))

    # lambdas of one parameter each: Spark takes a second one for the place in the array
    def passing(k: int):
        return lambda at: passes(at, k)

    def fitting(n: int, k: int):
        return lambda at: (F.size(words) >= n) & chosen(at, n, k)

    def rows(n: int, k: int):
        return lambda at: row(at, n, k)

    parts = []
    for k in sorted({min(n, gram) for n in sizes}):
        places = F.when(F.size(words) >= k, F.filter(F.sequence(F.lit(1), F.size(words) - k + 1), passing(k)))
        places = F.coalesce(places, F.array().cast("array<int>"))
        for n in (n for n in sizes if min(n, gram) == k):
            parts.append(F.transform(F.filter(places, fitting(n, k)), rows(n, k)))
    empty = F.array().cast("array<struct<size:int,gram:bigint,windows:array<struct<start:int,words:string>>>>")
    return F.concat(*parts) if parts else empty


def _covered(spans: Column) -> Column:
    """Places inside at least one of the sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc: Column, x: Column) -> Column:
        end = (x["start"] + x["size"]).cast("long")
        fresh = F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], x["start"].cast("long")))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])
