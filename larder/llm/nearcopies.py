"""Near copies by consistent weighted sampling of TF-IDF shingles.

A dossier is a set of word shingles, each weighted by how often the dossier holds it and how rare it is in the corpus. Two dossiers
are near copies if the weighted Jaccard similarity of their sets (sum of smaller weights by sum of larger ones) reaches the threshold.

1. Blocks send each of their shingles once with the number of their dossiers that hold it; slices add these up and answer. Every dossier of the
   corpus counts.
2. A similarity of ``t`` needs a share of ``t`` of a dossier's weight in shingles that another dossier holds too. Dossiers below that have no near
   copy. The others are sampled: each sample is a shingle and a level of its weight, equal for two dossiers with the probability of
   their similarity (improved consistent weighted sampling). Dossiers with one set of weights are one node from here on.
3. Bands of samples are hashed; nodes that share a band meet in a bucket. Each node is compared with the centre of the buckets that it meets
   most often; that joins most copies of one text. Buckets that still hold several classes are compared
   in full inside a task, a bounded part against a bounded part, and only the links that join two classes leave it.
4. Classes are the connected components of the links.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.blocks import SMALL_BLOCK_BYTES, Blocks, combine, cut, gather, lookup, messages, pack, slice_bits, unpack
from larder.llm.components import components
from larder.llm.skew import with_group
from larder.llm.words import Words, mix
from larder.session import ensure_checkpoint_dir

SHINGLE = 5
THRESHOLD = 0.8
#: Of nodes at the threshold, 1 - (1 - 0.8 ** 5) ** 20 = 99.96 % share a bucket.
BANDS, BAND_SAMPLES = 20, 5
#: Nodes of a bucket that are compared in full with as many others in one task.
PART_NODES = 256
_TABLE_BITS = 15
#: Bits of a shingle's hash beyond those that number all shingles: one in 2 ** 12 shares its count with another.
_SPARE_BITS = 12

_SIGNED = "recipe_id long, node binary, weight double, bands array<long>, shingles binary"


def near_copies(
    dossiers: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS,
    band_samples: int = BAND_SAMPLES, block_bytes: int | None = None,
) -> DataFrame:
    """The class of near copies that each dossier belongs to.

    ``dossiers``: ``recipe_id`` and ``text``; other columns are ignored. Words are separated by blanks and compared unchanged. A text of fewer
    than ``shingle`` words is one shingle. The weight of a shingle is its count in the dossier times
    ``1 + log(rows / rows with it) / log(rows)``, of which one row with it counts as two.

    Returns one row per input row: ``recipe_id`` and ``class_id``, the smallest id of its class; a dossier without near copy is a class of its own.
    Texts without words are nobody's near copy. A row without an id has no class (null) and joins none. Rows that repeat an id and text are alike.
    """
    spark = dossiers.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/near-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    blocks = Blocks(dossiers, block_bytes, least=SMALL_BLOCK_BYTES)
    width = min(64, int(np.ceil(np.log2(max(2, blocks.bytes / 6)))) + _SPARE_BITS)
    bits = slice_bits(blocks.bytes // 6)
    counted = combine(blocks.send(partial(_count, shingle, width, bits)), _total)
    signed = stored(
        blocks.receive(counted, partial(_sign, shingle, width, threshold, bands, band_samples, blocks.rows), _SIGNED), "signed"
    )

    nodes = stored(signed.filter("shingles is not null").dropDuplicates(["node"]).drop("recipe_id"), "nodes")
    roots = _classes(nodes, threshold, folder, stored)

    members = signed.filter("recipe_id is not null and node is not null").select("recipe_id", "node")
    by_node = members.groupBy("node").agg(F.min("recipe_id").alias("first_id"), F.count("*").alias("group_rows"))
    rooted = by_node.join(roots, "node", "left").select("node", "first_id", "group_rows", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("group_rows"))
    named = with_group(rooted.withColumnRenamed("group_rows", "node_rows"), first, ["root"], rooted.count())
    named = named.select("node", "class_id", F.col("node_rows").alias("group_rows"))
    alone = signed.filter("recipe_id is null or node is null").select("recipe_id", F.col("recipe_id").alias("class_id"))
    return with_group(members, stored(named, "named"), ["node"], members.count()).select("recipe_id", "class_id").unionByName(alone)


def _classes(nodes: DataFrame, threshold: float, folder: str, stored) -> DataFrame:
    """``(node, root)`` of the nodes that have a near copy."""
    buckets = stored(nodes.select("node", F.posexplode("bands").alias("band", "cell")), "buckets")
    keys, total = ["band", "cell"], buckets.count()

    # each node against the centre that it meets most often
    groups = buckets.groupBy(keys).agg(F.min("node").alias("centre"), F.count("*").alias("group_rows"))
    met = with_group(buckets, groups.filter("group_rows > 1"), keys, total).filter("centre != node")
    met = met.groupBy("centre", "node").agg(F.count("*").alias("shared"))
    best = met.groupBy("node").agg(F.max_by("centre", F.struct("shared", "centre")).alias("centre"))
    links = stored(_verified(best, nodes, threshold), "links0")
    roots = components(links, f"{folder}/components0")

    # buckets of several classes; of those with the same nodes one
    labelled = stored(
        buckets.join(roots, "node", "left").select(*keys, "node", F.coalesce("root", "node").alias("label")), "labelled"
    )
    mixed = labelled.groupBy(keys).agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("group_rows"),
        F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"),
    )
    mixed = mixed.filter("low != high").groupBy("one", "two", "group_rows").agg(F.min(F.struct(*keys)).alias("k"))
    parts = F.ceil(F.col("group_rows") / F.lit(PART_NODES)).cast("int").alias("parts")
    among = with_group(labelled, stored(mixed.select("k.*", "group_rows", parts), "mixed"), keys, total)
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
    among = among.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    among = among.select(
        *keys, F.least("part", "other").alias("part1"), F.greatest("part", "other").alias("part2"), "node", "label"
    )

    def link(table):
        return _linked(threshold, table)

    full = among.join(nodes.select("node", "weight", "shingles"), "node")
    found = full.groupBy(*keys, "part1", "part2").applyInArrow(link, "a binary, b binary")
    return components(links.unionByName(stored(found, "links1")), f"{folder}/components1")


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)`` of the pairs that reach the threshold."""
    one = nodes.select("node", F.col("weight").alias("w1"), F.col("shingles").alias("s1"))
    two = nodes.select(F.col("node").alias("centre"), F.col("weight").alias("w2"), F.col("shingles").alias("s2"))
    return pairs.join(one, "node").join(two, "centre").mapInArrow(partial(_compare, threshold), "a binary, b binary")


def _idf(total: np.ndarray, rows: float) -> np.ndarray:
    """Weight of shingles by the number of dossiers that hold them; one says no more than two."""
    return 1.0 + (np.log(rows / np.maximum(total, 2.0)) / np.log(rows) if rows > 1 else np.zeros(len(total)))


class _Shingles:
    """Shingles of a block's dossiers: per dossier each once, sorted, with its count."""

    def __init__(self, size: int, width: int, table: pa.Table):
        texts = Words(table["text"])
        owner = texts.texts_of_words()
        at = texts.window_starts(size)
        hashes, of = [texts.window_hashes(at, size)], [owner[at]]
        for n in range(1, size):  # a short text is one shingle
            some = np.flatnonzero(texts.counts == n)
            hashes.append(texts.window_hashes(texts.first[some], n))
            of.append(some)
        shift = np.uint64(64 - width)
        of, cells = np.concatenate(of), np.concatenate(hashes) >> shift
        order = np.lexsort((cells, of))
        of, cells = of[order], cells[order]
        new = np.ones(len(cells), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (cells[1:] != cells[:-1])
        at = np.flatnonzero(new)
        self.counts = np.diff(np.append(at, len(cells)))
        self.dossier, self.cells = of[at], cells[at]


def _count(size: int, width: int, bits: int, block: int, table: pa.Table) -> pa.Table:
    cells, counts = np.unique(_Shingles(size, width, table).cells, return_counts=True)
    return messages(block, ((s, pack(cells[a:b], counts[a:b] - 1)) for s, a, b in cut(cells, bits, width)))


def _total(slice_number: int, blocks: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Dossiers that hold each shingle, where it is more than one."""
    (cells, more), _, begins = gather(payloads, 2)
    order = np.argsort(cells, kind="stable")
    new = np.ones(len(cells), dtype=bool)
    new[1:] = cells[order][1:] != cells[order][:-1]
    group = np.cumsum(new) - 1
    sums = np.bincount(group, weights=more[order].astype(np.float64) + 1)
    total = np.empty(len(cells), dtype=np.uint64)
    total[order] = sums[group].astype(np.uint64)
    for k, block in enumerate(blocks):
        part = slice(begins[k], begins[k + 1])
        shared = total[part] > 1
        if shared.any():
            yield block, pack(cells[part][shared], total[part][shared])


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1), logarithm of gamma(2, 1) and uniform variates that shingles are dealt by their hash."""
    rng = np.random.Generator(np.random.PCG64(20260711))
    u = 1.0 - rng.random((5, 1 << _TABLE_BITS))
    return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]


def samples(dossier: np.ndarray, cells: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples for each dossier (rows in ascending order of dossiers, cells ascending within)."""
    first = np.flatnonzero(np.diff(dossier, prepend=-1))
    sizes = np.diff(np.append(first, len(cells)))
    rate, log_c, shift = _draws()
    log_w = np.log(weights)
    out = np.empty((len(first), n), dtype=np.uint64)
    for k in range(n):
        place = (mix(cells + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        r, beta = rate[place], shift[place]
        level = np.floor(log_w / r + beta)
        log_a = log_c[place] - r * (level - beta + 1.0)
        least = np.repeat(np.minimum.reduceat(log_a, first), sizes)
        at = np.flatnonzero(log_a == least)
        at = at[np.searchsorted(at, first)]
        out[:, k] = mix(cells[at] ^ mix(level[at].astype(np.int64).view(np.uint64)))
    return out


def _sign(
    size: int, width: int, threshold: float, bands: int, band_samples: int, rows: int, block: int, table: pa.Table, answers: list[bytes]
) -> pa.Table:
    sets = _Shingles(size, width, table)
    (known, totals), _, _ = gather(answers, 2)
    order = np.argsort(known)
    known, totals = known[order], totals[order]
    place = lookup(sets.cells, known)
    total = np.where(place >= 0, totals[np.maximum(place, 0)] if len(totals) else 1, 1).astype(np.float64)
    weights = sets.counts * _idf(total, rows)
    n = table.num_rows
    weight = np.bincount(sets.dossier, weights=weights, minlength=n)
    common = np.bincount(sets.dossier, weights=weights * (total > 1), minlength=n)
    alive = (weight > 0) & (common >= (threshold - 1e-9) * weight) & table["recipe_id"].is_valid().to_numpy(zero_copy_only=False)

    node: list[bytes | None] = [None] * n
    heavy: dict[bytes, int] = {}
    some = alive[sets.dossier]
    of, cells, counts, kept_total = sets.dossier[some], sets.cells[some], sets.counts[some].astype(np.uint64), total[some]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    if len(first):
        one = np.add.reduceat(mix(cells) * counts, first)
        two = np.add.reduceat(mix(mix(cells) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * counts, first)
        for k, dossier in enumerate(of[first].tolist()):
            key = one[k].tobytes() + two[k].tobytes()
            node[dossier] = key
            heavy.setdefault(key, dossier)
    chosen = np.isin(of, np.fromiter(heavy.values(), np.int64, len(heavy)))
    of, cells, counts, kept_total, weights = of[chosen], cells[chosen], counts[chosen], kept_total[chosen], weights[some][chosen]
    band_of: list = [None] * n
    shingles: list = [None] * n
    mass: list = [None] * n
    if len(of):
        drawn = samples(of, cells, weights, bands * band_samples).reshape(-1, bands, band_samples)
        hashed = np.zeros(drawn.shape[:2], dtype=np.uint64)
        for k in range(band_samples):
            hashed = mix(hashed + drawn[:, :, k])
        first = np.flatnonzero(np.diff(of, prepend=-1))
        for k, (a, b) in enumerate(zip(first, np.append(first[1:], len(of)), strict=True)):
            d = int(of[a])
            shared = kept_total[a:b] > 1
            band_of[d] = hashed[k].view(np.int64).tolist()
            shingles[d] = pack(cells[a:b][shared], counts[a:b][shared], kept_total[a:b][shared].astype(np.uint64))
            shingles[d] = np.float64(rows).tobytes() + shingles[d]
            mass[d] = float(weight[d])
    return pa.table(
        {
            "recipe_id": table["recipe_id"],
            "node": pa.array(node, pa.binary()),
            "weight": pa.array(mass, pa.float64()),
            "bands": pa.array(band_of, pa.list_(pa.int64())),
            "shingles": pa.array(shingles, pa.binary()),
        }
    )


def _compare(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of which the weighted Jaccard similarity reaches the threshold."""
    for batch in batches:
        last, centre, similar = None, None, []
        for s1, w1, s2, w2 in zip(*(batch.column(c).to_pylist() for c in ("s1", "w1", "s2", "w2")), strict=True):
            if s2 is not last and s2 != last:
                last, centre = s2, unpack(s2[8:])
            cells, counts, total = unpack(s1[8:])
            rows = float(np.frombuffer(s1[:8])[0])
            place = lookup(cells, centre[0])
            both = place >= 0
            smaller = np.minimum(counts[both], centre[1][place[both]])
            common = float((smaller * _idf(total[both].astype(np.float64), rows)).sum())
            similar.append(common >= (threshold - 1e-9) * (w1 + w2 - common))
        mask = pa.array(similar, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("node").filter(mask), batch.column("centre").filter(mask)], ["a", "b"])


#: Counts up to which a shingle is compared level by level.
_LEVELS = 8
_COLUMNS = 2048


def common_weights(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the smaller weights of each two sets; a set is its shingles, their counts and their idf."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(c) for c, _, _ in sets])
    cells, counts, idf = (np.concatenate([s[k] for s in sets]) for k in range(3))
    counts = counts.astype(np.int64)
    total = np.zeros((n, n))
    distinct, which, times = np.unique(cells, return_inverse=True, return_counts=True)
    # min(a, b) is the number of levels that both reach
    for level in range(1, _LEVELS + 1):
        reach = (counts >= level) & (times[which] > 1)
        features, column, times_here = np.unique(which[reach], return_inverse=True, return_counts=True)
        order = np.argsort(column, kind="stable")
        column, rows, weights = column[order], owner[reach][order], idf[reach][order]
        for low in range(0, len(features), _COLUMNS):
            a, b = np.searchsorted(column, [low, low + _COLUMNS])
            block = np.zeros((n, min(_COLUMNS, len(features) - low)))
            block[rows[a:b], column[a:b] - low] = np.sqrt(weights[a:b])
            total += block @ block.T
    more = (counts > _LEVELS) & (times[which] > 1)
    for feature in np.unique(which[more]):
        some = np.flatnonzero(more & (which == feature))
        left = (counts[some] - _LEVELS) * idf[some]
        total[np.ix_(owner[some], owner[some])] += np.minimum.outer(left, left)
    return total


def _linked(threshold: float, table: pa.Table) -> pa.Table:
    """Links between nodes of different labels that reach the threshold, as many as it takes to join their classes."""
    table = table.sort_by("node")
    nodes, sets = table["node"].to_pylist(), []
    for shingles in table["shingles"].to_pylist():
        cells, counts, total = unpack(shingles[8:])
        sets.append((cells, counts, _idf(total.astype(np.float64), float(np.frombuffer(shingles[:8])[0]))))
    weight = table["weight"].to_numpy()
    common = common_weights(sets)
    labels = table["label"].to_pylist()
    one, two = np.nonzero(common >= (threshold - 1e-9) * (weight[:, None] + weight[None, :] - common))
    root = {label: label for label in labels}

    def find(label):
        while root[label] != label:
            root[label] = root[root[label]]
            label = root[label]
        return label

    links = []
    for i, j in zip(one.tolist(), two.tolist(), strict=True):
        if i < j and labels[i] != labels[j] and (x := find(labels[i])) != (y := find(labels[j])):
            root[x] = y
            links.append((nodes[i], nodes[j]))
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})
