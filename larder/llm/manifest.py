"""Merkle manifest of dossiers: a tree per source, a tree over the sources, and folding of replaced dossiers.

A leaf is the digest of a dossier's fields. In each source the leaves stand by ``recipe_id``; up to sixteen neighbours have a parent, and
so on up to the source's subroot, and subroots have parents in the same way up to the root. A parent keeps the
state of its hash before each child (:mod:`larder.llm.midstates`). To fold a dossier that was replaced, the parent takes up the
state before that child, adds the replacement and the children right of it, and hands its new digest to its own parent;
what lies left of the child is never hashed again.

Places in a source come from range partitioning (a source with a third of all dossiers is spread over many tasks); parents
group sixteen rows at most. Each level is written to the shared folder and has a sixteenth of the rows of the level below.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.midstates import DIGEST, FAN, hash_children, resume
from larder.plans.joins import group_ordinals
from larder.session import ensure_checkpoint_dir

#: The fields of a leaf, in their order.
FIELDS = ("recipe_id", "source", "language", "n_chars", "text")
#: Nodes whose dossiers a task folds at once.
_NODES = 256
_MEMBERS = "members array<struct<slot:int,digest:binary,recipe_id:bigint,found:binary>>"
_NODE = f"tree string, position long, size long, {_MEMBERS}, digest binary, states binary"
_CHECKED = "recipe_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
_PATH = "path array<struct<children:binary,state:binary,slot:int>>"


@dataclass(frozen=True)
class Manifest:
    """Nodes of the source trees and of the tree over the sources, from the lowest level up; empty without dossiers.

    A row of a level: ``tree``, ``position`` in the level, ``size`` (nodes of that level of the tree), ``members`` (children by slot; dossiers at
    the lowest level of a source), ``digest`` and ``states`` (32 bytes before each child; none where a single leaf stands for itself).
    """

    sources: list[DataFrame]
    tops: list[DataFrame]
    root: str | None


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (hexadecimal) of the fields one after the other: ``-`` for null, else UTF-8 bytes, ``:`` and the value."""

    def shown(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(shown, fields)).cast("binary"), 256)


def build_manifest(dossiers: DataFrame, found_text: Column | None = None) -> Manifest:
    """The manifest of ``dossiers`` (the columns of ``FIELDS``; others do not matter).

    ``found_text`` is the text that a later reading of a dossier found, an expression over its columns; the digest of what was found is kept
    beside the leaf, for :func:`check_dossiers`. Nulls in any field have a mark of their own; dossiers without a source form a
    tree that stands first; those without an id stand first in their tree. Repeated rows are leaves each. No dossiers: no nodes, no root.
    """
    spark = dossiers.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    fields = [F.col(f"`{f}`") for f in FIELDS]
    found = F.lit(None).cast("binary")
    if found_text is not None:
        other = F.unhex(leaf_digest(*fields[:-1], found_text))
        found = F.when(~found_text.eqNullSafe(fields[-1]), other)
    leaves = dossiers.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("recipe_id").cast("long").alias("recipe_id"),
        F.unhex(leaf_digest(*fields)).alias("digest"),
        found.alias("found"),
    )
    leaves = stored(leaves, "leaves")
    order = [F.col("recipe_id").asc_nulls_first(), F.col("digest")]
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.agg(F.max("size")).first()[0]
    if largest is None:
        return Manifest([], [], None)
    placed = group_ordinals(leaves, ["tree"], order, "ordinal")
    # the size of a tree travels with its last leaf only: the parent of that one knows it, the others need not
    last = sizes.select("tree", F.col("size").alias("ordinal"), "size")
    rows = placed.join(last, ["tree", "ordinal"], "left").withColumn("position", F.col("ordinal") - 1)

    def levels(rows: DataFrame, most: int, name: str, members: list[Column]) -> list[DataFrame]:
        built: list[DataFrame] = []
        while True:
            parents = rows.groupBy("tree", F.expr(f"position div {FAN}").alias("position")).agg(
                F.max("size").alias("size"),
                F.sort_array(F.collect_list(F.struct((F.col("position") % FAN).cast("int").alias("slot"), *members))).alias("members"),
            )
            built.append(stored(parents.mapInArrow(_hashed, _NODE), f"{name}-{len(built)}"))
            most = -(-most // FAN)
            if most <= 1:
                return built
            above = built[-1].filter("size is null or size > 1")
            rows = above.select("tree", "position", "size", "digest")
            members = [F.col("digest"), F.lit(None).cast("long").alias("recipe_id"), F.lit(None).cast("binary").alias("found")]

    own = [F.col("digest"), F.col("recipe_id"), F.col("found")]
    sources = levels(rows, largest, "source", own)
    subroots = sources[0].filter("size = 1")
    for level in sources[1:]:
        subroots = subroots.unionByName(level.filter("size = 1"))
    subroots = stored(group_ordinals(subroots.select(F.lit("").alias("all"), "tree", "digest"), ["all"], [F.col("tree")], "n"), "subroots")
    trees = subroots.count()
    listed = subroots.select(
        F.col("all").alias("tree"),
        (F.col("n") - 1).alias("position"),
        F.when(F.col("n") == trees, F.lit(trees)).cast("long").alias("size"),
        "digest",
        # a source is a member of the upper tree under its position
        F.lit(None).cast("long").alias("recipe_id"),
        F.lit(None).cast("binary").alias("found"),
    )
    tops = levels(listed, trees, "top", own)
    root = tops[-1].select(F.lower(F.hex("digest"))).first()[0]
    return Manifest(sources, [*tops, subroots], root)


def check_dossiers(manifest: Manifest) -> DataFrame:
    """One row per dossier: its leaf, the subroot of its source, the root, the digest of its proof, and the root folded from what was found.

    Columns: ``recipe_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the siblings on the way to the root, from the left in each
    level), ``folded_root`` and ``verified`` (whether that is the root). A dossier is folded by itself, against the siblings of the manifest.
    A manifest without dossiers has no rows.
    """
    if manifest.root is None:
        return SparkSession.active().createDataFrame([], f"{_CHECKED.replace('proof', 'root string not null, proof')}, verified boolean")
    *tops, subroots = manifest.tops
    path = F.array().cast(_PATH.split(" ", 1)[1])
    above = tops[-1].select("position", "members", "states", path.alias("path"))
    for level in reversed(tops[:-1]):
        above = _below(level, above, []).drop("parent")
    named = subroots.select("tree", (F.col("n") - 1).alias("place"), F.col("digest").alias("subroot"))
    up = above.select(F.col("position").alias("up_position"), "members", "states", F.col("path").alias("up_path"))
    named = named.join(up, F.expr(f"place div {FAN}") == F.col("up_position"))
    named = named.select("tree", "subroot", _extended(F.expr(f"cast(place % {FAN} as int)"), "members", "states", "up_path").alias("path"))
    placed = None
    for level in reversed(manifest.sources):
        own = level.select("tree", "position", "size", "members", "states")
        at_top = own.filter("size = 1").join(named, "tree").drop("size")
        if placed is None:
            placed = at_top
        else:
            inner = _below(own.filter("size is null or size > 1").drop("size"), placed, ["tree"], "subroot")
            placed = at_top.unionByName(inner.select(*at_top.columns))
    checked = placed.select("members", "states", "subroot", "path").mapInArrow(_folded, _CHECKED)
    root = F.lit(manifest.root)
    return checked.select(
        "recipe_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def _extended(slot: Column, members: str, states: str, path: str) -> Column:
    """The path of a child: the children and the kept state of its parent, then the parent's own path."""
    children = F.expr(f"aggregate({members}, cast('' as binary), (b, m) -> concat(b, m.digest))")
    step = F.struct(children.alias("children"), F.substring(F.col(states), slot * DIGEST + 1, F.lit(DIGEST)).alias("state"), slot.alias("slot"))
    # a single leaf that stands for itself has no parent on its way
    return F.when(F.octet_length(F.col(states)) == 0, F.col(path)).otherwise(F.concat(F.array(step), F.col(path)))


def _below(level: DataFrame, above: DataFrame, keys: list[str], *handed: str) -> DataFrame:
    """The nodes of ``level`` with their paths, from the level above with its paths."""
    renamed = above.select(
        *keys, *handed, F.col("position").alias("parent"), F.col("members").alias("up_members"), F.col("states").alias("up_states"), F.col("path").alias("up_path")
    )
    joined = level.withColumn("parent", F.expr(f"position div {FAN}")).join(renamed, [*keys, "parent"])
    slot = F.expr(f"cast(position % {FAN} as int)")
    return joined.select(
        *keys, "parent", "position", "members", "states", *handed, _extended(slot, "up_members", "up_states", "up_path").alias("path")
    )


def _rows_of(column: pa.Array) -> np.ndarray:
    """Digests as rows of 32 bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, DIGEST)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pc.list_value_length(batch.column("members")).to_numpy(zero_copy_only=False).astype(np.int64)
        digests = _rows_of(pc.struct_field(batch.column("members").flatten(), "digest"))
        first = np.cumsum(counts) - counts
        # a tree of one leaf: the leaf is the subroot
        alone = (pc.fill_null(batch.column("size"), 0).to_numpy(zero_copy_only=False) == 1) & (counts == 1)
        own, states, digest = [], [], []
        for low in range(0, batch.num_rows, _NODES):
            begin, end = first[low], first[low] + counts[low : low + _NODES].sum()
            made, kept = hash_children(digests[begin:end], counts[low : low + _NODES])
            own.append(made)
            states += [kept[a - begin : a - begin + n].tobytes() for a, n in zip(first[low : low + _NODES], counts[low : low + _NODES], strict=True)]
        made = np.concatenate([np.zeros((0, DIGEST), np.uint8), *own])
        digest = [(digests[first[k]] if alone[k] else made[k]).tobytes() for k in range(batch.num_rows)]
        size = pc.cast(pc.divide(pc.add(batch.column("size"), FAN - 1), FAN), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("tree"),
                batch.column("position"),
                size,
                batch.column("members"),
                pa.array(digest, pa.binary()),
                pa.array([b"" if alone[k] else states[k] for k in range(batch.num_rows)], pa.binary()),
            ],
            ["tree", "position", "size", "members", "digest", "states"],
        )


def _without(text: str, slot: int) -> str:
    return text[: 2 * DIGEST * slot] + text[2 * DIGEST * (slot + 1) :]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, _NODES):
            batch = whole.slice(low, _NODES)
            counts = pc.list_value_length(batch.column("members")).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column("members").flatten()
            ids, digests, found = (pc.struct_field(flat, f) for f in ("recipe_id", "digest", "found"))
            first = np.cumsum(counts) - counts
            leaves, value = _rows_of(digests), _rows_of(pc.coalesce(found, digests)).copy()
            node = np.repeat(np.arange(len(counts)), counts)
            slots = np.arange(len(node)) - first[node]
            states, paths = batch.column("states").to_pylist(), batch.column("path").to_pylist()
            siblings = []
            for k, path in enumerate(paths):
                siblings.append("".join(_without(step["children"].hex(), step["slot"]) for step in path))
                if states[k]:
                    own = {"children": leaves[first[k] : first[k] + counts[k]].tobytes(), "state": None, "slot": None}
                    paths[k] = [own, *path]
            for height in range(max(map(len, paths), default=0)):
                on = np.flatnonzero(np.array([len(p) > height for p in paths])[node])
                kept = np.zeros((len(paths), FAN, DIGEST), dtype=np.uint8)  # states before each slot, or before the one of the path
                around = np.zeros((len(paths), FAN, DIGEST), dtype=np.uint8)
                many, at = np.zeros(len(paths), dtype=np.int64), np.zeros(len(paths), dtype=np.int64)
                for k, path in enumerate(paths):
                    if len(path) <= height:
                        continue
                    step = path[height]
                    children = np.frombuffer(step["children"], np.uint8).reshape(-1, DIGEST)
                    many[k], around[k, : len(children)] = len(children), children
                    if step["slot"] is None:
                        kept[k, : len(children)], at[k] = np.frombuffer(states[k], np.uint8).reshape(-1, DIGEST), -1
                    else:
                        kept[k, step["slot"]], at[k] = np.frombuffer(step["state"], np.uint8), step["slot"]
                of = node[on]
                where = np.where(at[of] < 0, slots[on], at[of])
                value[on] = resume(kept[of, where], value[on], around[of], where, many[of])
            texts = [leaves[a : a + n].tobytes().hex() for a, n in zip(first, counts, strict=True)]
            proofs = [hashlib.sha256((_without(texts[k], s) + siblings[k]).encode()).hexdigest() for k, s in zip(node, slots, strict=True)]
            subroots = [s.hex() for s in batch.column("subroot").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([row.tobytes().hex() for row in leaves], pa.string()),
                    pa.array([subroots[k] for k in node], pa.string()),
                    pa.array(proofs, pa.string()),
                    pa.array([row.tobytes().hex() for row in value], pa.string()),
                ],
                ["recipe_id", "leaf", "subroot", "proof_sha256", "folded_root"],
            )
