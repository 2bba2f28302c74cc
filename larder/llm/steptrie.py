"""Prefix trie of recipe steps: which beginnings recipes have in common, and what storing each once would save.

A burst trie. A container holds the suffixes (what is left of their steps) of all recipes that share a beginning, its head. A container with
too many is burst: the steps that all its suffixes begin with become a chain, and the next step deals the suffixes to new
containers. All other containers are packed into shards; a task sorts the suffixes of its containers and sweeps over neighbours: where a
suffix leaves its predecessor its new nodes begin, and the nodes below a node follow it without a gap.

A step is 24 bytes, the hash of its fields and the size of its text, so texts are read once and never shuffled. Equal suffixes are merged
before anything else; long recipes go on in further segments, whose heads are the ends of the segments before. So no task holds more than a shard, whatever
recipe, beginning or group of copies most rows belong to. The totals of burst containers are added up from the lowest level to the root.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.skew import with_group
from larder.plans.joins import group_ordinals
from larder.session import ensure_checkpoint_dir

#: Bytes of a step.
CODE = 24
#: Steps of a segment; suffixes and bytes of a container that is not burst; bytes of a shard.
SEGMENT, MOST_SUFFIXES, MOST_BYTES, SHARD_BYTES = 1024, 4096, 4 << 20, 4 << 20
_ROOT = bytes(16)
NODES = (
    "recipe_id long, depth long, parent_recipe_id long, n_recipes long, n_children long, n_leaves long, saved_bytes long, ends_sha256 string"
)
_SWEPT = "head binary, recipe_id long, depth long, parent_recipe_id long, n_recipes long, n_children long, n_leaves long, saved_bytes long, ends string"
_ITEM = ("head", "depth", "seq", "down", "ends", "first", "n")
_NOBODY = hashlib.sha256(b"").hexdigest()


def step_code(fields: Sequence[str], text: str) -> Column:
    """The step as 24 bytes: 128 bits of the SHA-256 of its fields, and the UTF-8 bytes of ``text``; null counts as empty."""
    values = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    whole = F.concat(*[F.concat(F.octet_length(v).cast("string"), F.lit(":"), v) for v in values])
    size = F.octet_length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("long")
    return F.unhex(F.concat(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32), F.lpad(F.hex(size), 16, "0")))


def number_steps(recipe_steps: DataFrame, fields: Sequence[str] = ("text",), text: str = "text") -> DataFrame:
    """``(recipe_id, position, code)``: the steps of each recipe by ``step_no``, from 1 on, and their codes.

    A null ``step_no`` comes first; steps of one number stand by code; steps without a recipe are left out. ``fields`` make steps equal or different.
    """
    coded = recipe_steps.filter("recipe_id is not null").select(
        F.col("recipe_id").cast("long"), F.col("step_no").cast("long"), step_code(fields, text).alias("code")
    )
    spark = coded.sparkSession
    coded = _stored(coded, _folder(spark), "coded")
    order = [F.col("step_no").asc_nulls_first(), F.col("code")]
    return group_ordinals(coded, ["recipe_id"], order, "position").select("recipe_id", "position", "code")


def step_trie(recipes: DataFrame, recipe_steps: DataFrame, fields: Sequence[str] = ("text",), text: str = "text") -> DataFrame:
    """The nodes of the trie of ``recipe_steps`` (``recipe_id``, ``step_no`` and ``fields``) of ``recipes`` (``id``). See :func:`grow_trie`."""
    return grow_trie(recipes.select(F.col("id").alias("recipe_id")), number_steps(recipe_steps, fields, text))


def grow_trie(
    recipes: DataFrame,
    placed: DataFrame,
    segment: int = SEGMENT,
    most_suffixes: int = MOST_SUFFIXES,
    most_bytes: int = MOST_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per node, that is per different beginning of ``depth`` steps (0: the root, that all recipes share).

    ``recipes``: ``recipe_id``; ``placed``: ``recipe_id``, ``position`` (1, 2, ...) and ``code``. Columns of a node: ``recipe_id`` (the smallest that begins so),
    ``depth``, ``parent_recipe_id`` (that of the beginning one step shorter), ``n_recipes``, ``n_children``, ``n_leaves`` (nodes
    without children below it or itself), ``saved_bytes`` (over it and all nodes below it: recipes but one, times the size of the last step) and
    ``ends_sha256`` (SHA-256 of the ids of the recipes that end here, ascending, with commas).

    A recipe without steps ends at the root. Recipes without an id and steps of unknown recipes are left out, repeated recipes count once; no recipes, no nodes.
    The ids that end at one node are hashed one after the other, as the digest asks for, in a stream of sorted pieces.
    """
    spark = recipes.sparkSession
    folder = _folder(spark)
    known = recipes.select(F.col("recipe_id").cast("long")).dropna().distinct()
    segments = _segments(known, placed, segment, folder)
    seen = segments.agg(F.max("round"), F.min("recipe_id")).first()
    if seen[1] is None:
        return spark.createDataFrame([], NODES)
    rounds, items, ends = seen[0] + 1, [], []
    walks = segments.filter("round = 0").withColumn("head", F.lit(bytearray(_ROOT)))
    for r in range(rounds):
        end = F.unhex(F.md5(F.concat("head", "seq")))
        walks = walks.select("recipe_id", "head", "seq", F.when(F.col("full"), end).alias("down"), F.when(~F.col("full"), end).alias("ends"))
        if rounds > 1:
            walks = _stored(walks, folder, f"walks{r}")
        ends.append(walks.filter("ends is not null").select("ends", "recipe_id"))
        merged = walks.groupBy("head", "seq", "down", "ends").agg(F.min("recipe_id").alias("first"), F.count(F.lit(1)).alias("n"))
        items.append(merged.withColumn("depth", F.lit(r * segment).cast("long")).select(*_ITEM))
        if r + 1 < rounds:
            on = walks.filter("down is not null").select("recipe_id", F.col("down").alias("head"))
            walks = segments.filter(F.col("round") == r + 1).join(on, "recipe_id")
    digests = _stored(_digests(_union(ends)), folder, "ends")

    levels, front = [], None
    while items or front is not None:
        k = len(levels)
        # the containers of a round come after all that the round before was burst into: their totals are needed first
        rows = _stored(items.pop(0) if front is None else front, folder, f"items{k}")
        size = F.octet_length("seq")
        containers = rows.groupBy("head", "depth").agg(
            F.count(F.lit(1)).alias("group_rows"), F.sum(size).alias("bytes"), F.min("first").alias("head_first"), F.min("seq").alias("lo"), F.max("seq").alias("hi")
        )
        containers = _stored(containers, folder, f"containers{k}")
        big = containers.filter(f"group_rows > {most_suffixes} or (bytes > {most_bytes} and group_rows > 1)")
        if big.isEmpty():
            levels.append((rows, None, None))
            front = None
            continue
        total = containers.agg(F.sum("group_rows")).first()[0]
        heads = big.select("head", "group_rows", "head_first", _common("lo", "hi").alias("common"))
        dealt = _stored(with_group(rows, heads, ["head"], total), folder, f"dealt{k}")
        small = rows.join(big.select("head"), "head", "left_anti")
        inner = F.octet_length("seq") > F.octet_length("common")
        edge = F.octet_length("common") + CODE
        onward = dealt.filter(inner).select(
            "head",
            # a name of its own: a further segment may begin at the same node
            F.unhex(F.md5(F.concat(F.lit(bytearray(b"part")), "head", F.substring(F.col("seq"), F.lit(1), edge)))).alias("part"),
            (F.col("depth") + edge / CODE).cast("long").alias("depth"),
            F.conv(F.hex(F.substring(F.col("seq"), edge - 7, F.lit(8))), 16, 10).cast("long").alias("weight"),
            F.substring(F.col("seq"), edge + 1, F.octet_length("seq")).alias("seq"),
            "down", "ends", "first", "n", "head_first", "common",
        )
        onward = _stored(onward, folder, f"onward{k}")
        new = onward.groupBy("head", "part", "depth", "weight", "head_first", "common").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        front = onward.select(F.col("part").alias("head"), *_ITEM[1:])
        levels.append((small, dealt.filter(~inner), _stored(new, folder, f"parts{k}")))

    nodes, totals = [], spark.createDataFrame([], "head binary, children long, leaves long, saved long, own_ends string")
    for k in range(len(levels) - 1, -1, -1):
        small, stopped, new = levels[k]
        chain = None
        if new is not None:
            under = new.join(totals.withColumnRenamed("head", "part"), "part", "left")
            n_leaves = F.when(F.coalesce("children", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("leaves"))
            saved = (F.col("n") - 1) * F.col("weight") + F.coalesce("saved", F.lit(0))
            tops = under.select(
                "head", "common", "head_first", F.col("first").alias("recipe_id"), "depth", F.col("head_first").alias("parent_recipe_id"), F.col("n").alias("n_recipes"),
                F.coalesce("children", F.lit(0)).cast("long").alias("n_children"), n_leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_bytes"), F.col("own_ends").alias("ends"),
            )
            tops = _stored(tops, folder, f"tops{k}")
            nodes.append(tops.select(*_NODE_COLUMNS))
            chain = tops.groupBy("head", "common").agg(
                F.min("recipe_id").alias("first"), F.sum("n_recipes").alias("n"), F.first(F.col("depth") - 1 - F.octet_length("common") / CODE).cast("long").alias("depth"),
                F.count(F.lit(1)).alias("b_children"), F.sum("n_leaves").alias("b_leaves"), F.sum("saved_bytes").alias("b_saved"),
            )
            none = F.lit(None).cast("binary")
            chain = chain.select("head", "depth", F.col("common").alias("seq"), "first", "n", F.lit(None).cast("string").alias("ends"), "b_children", "b_leaves", "b_saved")
        held = small.select(*_ITEM) if stopped is None else small.select(*_ITEM).unionByName(stopped.select(*_ITEM))
        swept = _weighed(held, digests, totals if rounds > 1 else None)
        swept = swept if chain is None else swept.unionByName(chain)
        whole = small.agg(F.sum(F.octet_length("seq") + 64)).first()[0] or 0
        shards = max(1, -(-whole // shard_bytes))
        shard = F.pmod(F.xxhash64("head"), F.lit(shards)).cast("int").alias("shard")
        done = _stored(swept.select("*", shard).groupBy("shard").applyInArrow(_swept, _SWEPT), folder, f"swept{k}")
        nodes.append(done.filter("recipe_id is not null").select(*_NODE_COLUMNS))
        own = done.filter("recipe_id is null").select(
            "head", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_bytes").alias("saved"), F.col("ends").alias("own_ends")
        )
        totals = own if new is None and k == len(levels) - 1 else totals.unionByName(own)
    top = totals.filter(F.col("head") == F.lit(bytearray(_ROOT)))
    everyone = F.lit(known.count()).cast("long")
    leaves = F.when(F.col("children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves"))
    root = top.select(
        F.lit(seen[1]).cast("long").alias("recipe_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_recipe_id"),
        everyone.alias("n_recipes"), F.col("children").alias("n_children"), leaves.alias("n_leaves"), F.col("saved").alias("saved_bytes"), F.col("own_ends").alias("ends"),
    )
    every = _union([root, *nodes])
    return every.withColumn("ends_sha256", F.coalesce("ends", F.lit(_NOBODY))).drop("ends")


def _weighed(items: DataFrame, digests: DataFrame, totals: DataFrame | None) -> DataFrame:
    """Items with the digest of the recipes that end there, or with what lies in the containers of their further segments."""
    keys = ["head", "depth", "seq", "first", "n"]
    nothing = [F.lit(0).cast("long").alias(b) for b in ("b_children", "b_leaves", "b_saved")]
    out = items.filter("ends is not null").join(digests, "ends").select(*keys, F.col("digest").alias("ends"), *nothing)
    if totals is None:
        return out
    under = totals.select(F.col("head").alias("down"), "children", "leaves", "saved", "own_ends")
    longer = items.filter("down is not null").join(under, "down")
    return out.unionByName(
        longer.select(*keys, F.col("own_ends").alias("ends"), F.col("children").alias("b_children"), F.col("leaves").alias("b_leaves"), F.col("saved").alias("b_saved"))
    )


_NODE_COLUMNS = ("recipe_id", "depth", "parent_recipe_id", "n_recipes", "n_children", "n_leaves", "saved_bytes", "ends")


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _segments(known: DataFrame, placed: DataFrame, size: int, folder: str) -> DataFrame:
    """``(recipe_id, round, seq, full)``: runs of ``size`` steps and, for each recipe, one last run with fewer or none."""
    steps = F.sort_array(F.collect_list(F.struct("position", "code")))
    packed = F.unhex(F.array_join(F.transform(steps, lambda s: F.hex(s["code"])), ""))
    runs = placed.groupBy("recipe_id", F.expr(f"cast((position - 1) div {size} as int)").alias("round")).agg(packed.alias("seq"))
    runs = _stored(runs.withColumn("full", F.octet_length("seq") == size * CODE), folder, "runs")
    last = runs.groupBy("recipe_id").agg(F.max(F.struct("round", "full")).alias("last"))
    closing = known.join(last, "recipe_id", "left").filter("last is null or last.full")
    empty = closing.select(
        "recipe_id", F.coalesce(F.col("last.round") + 1, F.lit(0)).alias("round"), F.lit(bytearray()).alias("seq"), F.lit(False).alias("full")
    )
    return _stored(runs.join(known, "recipe_id", "left_semi").unionByName(empty), folder, "segments")


def _common(lo: str, hi: str) -> Column:
    """The steps that two sequences begin with."""
    n = f"cast(least(octet_length({lo}), octet_length({hi})) div {CODE} as int)"
    at = f"i * {CODE} + 1, {CODE}"
    first = f"array_min(filter(sequence(0, {n} - 1), i -> substring({lo}, {at}) != substring({hi}, {at})))"
    return F.expr(f"substring({lo}, 1, {CODE} * case when {n} = 0 then 0 else coalesce({first}, {n}) end)")


def _digests(ends: DataFrame) -> DataFrame:
    """``(ends, digest)``: SHA-256 of the ids of each end.

    The ids are written out as pieces of text where they lie in order, over many tasks; what one task hashes in the end is a stream of pieces.
    """
    order = ["ends", "recipe_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_id_texts, "ends binary, first long, ids binary")
    return pieces.repartition("ends").sortWithinPartitions("ends", "first").mapInArrow(_hash_texts, "ends binary, digest string")


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One piece per end and batch, its ids in decimal with commas."""
    for batch in batches:
        keys, ids = batch.column("ends").to_pylist(), batch.column("recipe_id").to_pylist()
        starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        texts = [",".join(map(str, ids[a:b])).encode() for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        columns = [pa.array([keys[k] for k in starts], pa.binary()), pa.array([ids[k] for k in starts], pa.int64()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["ends", "first", "ids"])


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    for batch in batches:
        out, digests = [], []
        for end, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if end == key:
                state.update(b"," + ids)
                continue
            if key is not None:
                out.append(key)
                digests.append(state.hexdigest())
            key, state = end, hashlib.sha256(ids)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(digests, pa.string())], ["ends", "digest"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["ends", "digest"])


def _swept(table: pa.Table) -> pa.Table:
    """The nodes below the heads of all containers of a shard, and per head (without ``recipe_id``) what they add up to."""
    heads, seqs = table["head"].to_pylist(), table["seq"].to_pylist()
    order = sorted(range(len(seqs)), key=lambda i: (heads[i], seqs[i]))
    heads, seqs = [heads[i] for i in order], [seqs[i] for i in order]
    ends = [table["ends"][i].as_py() for i in order]
    depth, first, n, b_children, b_leaves, b_saved = (
        table[c].to_numpy()[order].astype(np.int64) for c in ("depth", "first", "n", "b_children", "b_leaves", "b_saved")
    )
    size = np.array([len(s) for s in seqs], dtype=np.int64) // CODE
    flat = np.frombuffer(b"".join(seqs), dtype=np.uint8).reshape(-1, CODE)
    codes, weights = flat[:, :16].copy().view(np.uint64), flat[:, 16:].copy().view(">u8").astype(np.int64)[:, 0]
    off = np.cumsum(size) - size
    opens = np.array([k == 0 or heads[k] != heads[k - 1] for k in range(len(heads))])
    box = np.cumsum(opens) - 1
    box_first, box_depth = np.minimum.reduceat(first, np.flatnonzero(opens)), depth[opens]

    # steps that each suffix shares with its predecessor
    both = np.where(opens, 0, np.minimum(size, np.concatenate([[0], size[:-1]])))
    pair = np.repeat(np.arange(len(size)), both)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(both) - both, both)
    differ = (codes[off[pair - 1] + step] != codes[off[pair] + step]).any(axis=1) if len(pair) else np.zeros(0, bool)
    shared = both.copy()
    np.minimum.at(shared, pair[differ], step[differ])

    # all (suffix, depth) pairs by depth: a node begins where a suffix leaves its predecessor
    item = np.repeat(np.arange(len(size)), size)
    level = np.arange(len(item)) - off[item] + 1
    new = level > shared[item]
    by_depth = np.argsort(level, kind="stable")
    begins = np.flatnonzero(new[by_depth])
    node_of = np.empty(len(item), dtype=np.int64)
    node_of[by_depth] = np.cumsum(new[by_depth]) - 1
    made = by_depth[begins]
    members = np.add.reduceat(n[item[by_depth]], begins) if len(begins) else np.zeros(0, np.int64)
    smallest = np.minimum.reduceat(first[item[by_depth]], begins) if len(begins) else np.zeros(0, np.int64)
    closes = np.concatenate([begins[1:], [len(item)]]) - 1 if len(begins) else np.zeros(0, np.int64)
    creator, last, at = item[made], item[by_depth][closes], level[made]
    parent = np.where(at > 1, node_of[np.maximum(made - 1, 0)], -1) if len(made) else np.zeros(0, np.int64)

    # nodes in the order of the sweep: those below a node follow it
    created = size - shared
    base = np.cumsum(created) - created
    place = base[creator] + at - shared[creator] - 1
    until = base[last] + created[last]
    nodes = len(made)
    own_saved, own_leaves, children = (members - 1) * weights[made], np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    np.add.at(children, parent[parent >= 0], 1)
    node_ends: list = [None] * nodes
    sums = np.zeros((3, int(opens.sum())), dtype=np.int64)
    box_ends: list = [None] * sums.shape[1]
    for k in np.flatnonzero((b_children > 0) | (b_saved > 0) | np.array([e is not None for e in ends])):
        if size[k]:
            node = node_of[off[k] + size[k] - 1]
            children[node] += b_children[k]
            own_leaves[node] += b_leaves[k]
            own_saved[node] += b_saved[k]
            node_ends[node] = ends[k] or node_ends[node]
        else:
            sums[:, box[k]] += b_children[k], b_leaves[k], b_saved[k]
            box_ends[box[k]] = ends[k] or box_ends[box[k]]
    own_leaves[children == 0] += 1

    def below(own: np.ndarray) -> np.ndarray:
        running = np.zeros(nodes + 1, dtype=np.int64)
        by_place = np.empty(nodes, dtype=np.int64)
        by_place[place] = own
        np.cumsum(by_place, out=running[1:])
        return running[until] - running[place]

    np.add.at(sums[0], box[creator[parent < 0]], 1)
    np.add.at(sums[1], box[creator], own_leaves)
    np.add.at(sums[2], box[creator], own_saved)
    above = np.where(parent >= 0, smallest[parent] if nodes else parent, box_first[box[creator]] if nodes else parent)
    empty = [None] * sums.shape[1]
    tail = [heads[k] for k in np.flatnonzero(opens)]
    columns = {
        "head": [*([None] * nodes), *tail],
        "recipe_id": [*smallest.tolist(), *empty],
        "depth": [*(box_depth[box[creator]] + at).tolist(), *empty],
        "parent_recipe_id": [*above.tolist(), *empty],
        "n_recipes": [*members.tolist(), *empty],
        "n_children": [*children.tolist(), *sums[0].tolist()],
        "n_leaves": [*below(own_leaves).tolist(), *sums[1].tolist()],
        "saved_bytes": [*below(own_saved).tolist(), *sums[2].tolist()],
        "ends": [*node_ends, *box_ends],
    }
    kinds = {"head": pa.binary(), "ends": pa.string()}
    return pa.table({name: pa.array(values, kinds.get(name, pa.int64())) for name, values in columns.items()})
