"""Merkle manifest of a dataset, with the proof of every row made by pointer jumping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefspark.session import settle

FANOUT = 8
#: Number of the tree over the subroots; the groups' trees are 0, 1, ...
TOP = -1
_NODE = ("tree", "level", "pos")
_SEGMENT = "array<struct<l:binary,r:binary>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values in order, each ``-`` where null and else its UTF-8 byte count, ``:`` and itself."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)).cast("binary"), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash_of(digests: Column) -> Column:
    """Digest over the hex text of an array of digests."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, hex_of), "").cast("binary"), 256))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b"").cast("binary"), lambda so_far, d: F.concat(so_far, d))


def proof_digest(proof: Column) -> Column:
    """SHA-256 in hex of all siblings of a proof, level by level, left to right."""
    siblings = F.transform(proof, lambda s: hex_of(F.concat(s.l, s.r)))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """Root in hex that a leaf digest leads to with the siblings of a proof."""
    return F.aggregate(
        proof,
        hex_of(leaf),
        lambda below, s: F.sha2(F.concat(hex_of(s.l), below, hex_of(s.r)).cast("binary"), 256),
    )


def _positions(df: DataFrame, group: Sequence[str], order: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``pos`` (0, 1, ... in each group, nulls first), and ``*group, size``.

    Rows are range-partitioned by group and order and numbered where they are written; counts of each part of a group
    move the numbers up. A group of a third of all rows is spread over as many ranges as its rows fill.
    """
    keys = [F.col(k).asc_nulls_first() for k in (*group, *order)]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = settle(
        ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), label
    )
    counted = stored.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    counted = settle(counted, f"{label}_parts")
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    offsets = counted.select("part", *[F.col(g).alias(f"_{g}") for g in group], moved.alias("moved"))
    same = reduce(
        lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col("part") == F.col("_part")
    )
    placed = stored.join(offsets.withColumnRenamed("part", "_part"), same).withColumn("pos", F.col("at") + F.col("moved"))
    return placed.drop("part", "at", "moved", "_part", *[f"_{g}" for g in group]), counted.groupBy(*group).agg(
        F.sum("n").alias("size")
    )


def _parts_of(kids: Column, i: Column) -> Column:
    """What lies left and right of digest ``i`` of its run."""
    left = F.slice(kids, F.lit(1), i)
    right = F.slice(kids, i + 2, F.lit(FANOUT))
    return F.struct(_joined(left).alias("l"), _joined(right).alias("r"))


def _climb(nodes: DataFrame, largest: int, label: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels above ``nodes(tree, level, pos, n, digest)`` of trees with up to ``largest`` of them.

    Gives the links ``tree, level, pos, up_tree, up_level, up_pos, segment`` of each level, and the tables whose rows
    with ``n = 1`` are the tops of their trees. Each level is a table an eighth as long as the one below.
    """
    links, tops = [], [nodes]
    while largest > 1:
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos"))
        kids = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        grown = runs.agg(
            (F.max("level") + 1).alias("level"),
            F.ceil(F.max("n") / FANOUT).cast("long").alias("n"),
            F.transform(kids, lambda k: k.digest).alias("kids"),
        )
        above = settle(grown.withColumn("digest", _hash_of(F.col("kids"))), label)
        kid = above.select(
            "tree",
            (F.col("level") - 1).alias("level"),
            F.col("tree").alias("up_tree"),
            F.col("level").alias("up_level"),
            F.col("pos").alias("up_pos"),
            "kids",
            F.posexplode("kids").alias("i", "_"),
        )
        links.append(
            kid.select(
                "tree",
                "level",
                (F.col("up_pos") * FANOUT + F.col("i")).alias("pos"),
                "up_tree",
                "up_level",
                "up_pos",
                F.array(_parts_of(F.col("kids"), F.col("i"))).alias("segment"),
            )
        )
        nodes = above.select("tree", "level", "pos", "n", "digest")
        tops.append(nodes)
        largest = -(-largest // FANOUT)
    return links, tops


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _paths(links: DataFrame, root: tuple[int, int, int]) -> DataFrame:
    """``tree, level, pos, segment, subroot``: each node's siblings all the way to ``root``.

    A node holds a pointer to an ancestor and the siblings on the way there. One self-join hands it the pointer and the
    siblings of that ancestor, so the distance doubles and the number of joins is the logarithm of the depth. The side
    that is looked up holds only nodes which lie that far above others: an eighth of the nodes at first, then a
    64th, a 4,096th and so on, so nearly all keys stay small, and where a few nodes are asked for by all rows Spark broadcasts them.
    """
    at_root = (F.col("up_tree") == root[0]) & (F.col("up_level") == root[1]) & (F.col("up_pos") == root[2])
    done, current, distance = [], settle(links, "merkle_links"), 1
    while True:
        done.append(current.where(at_root))
        waiting = current.where(~at_root)
        if waiting.isEmpty():
            return _union(done).select(*_NODE, "segment", "subroot")
        known = _union([*done, waiting]).where((F.col("tree") == TOP) | (F.col("level") > distance))
        up = known.select(
            F.col("tree").alias("a"),
            F.col("level").alias("b"),
            F.col("pos").alias("c"),
            *[F.col(n).alias(f"far_{n}") for n in ("up_tree", "up_level", "up_pos", "segment", "subroot")],
        )
        met = waiting.join(up, (F.col("up_tree") == F.col("a")) & (F.col("up_level") == F.col("b")) & (F.col("up_pos") == F.col("c")))
        current = settle(
            met.select(
                *_NODE,
                F.col("far_up_tree").alias("up_tree"),
                F.col("far_up_level").alias("up_level"),
                F.col("far_up_pos").alias("up_pos"),
                F.concat("segment", "far_segment").alias("segment"),
                F.coalesce("subroot", "far_subroot").alias("subroot"),
            ),
            "merkle_pointers",
        )
        distance *= 2


def proofs(
    df: DataFrame,
    leaf: Column,
    other: Column | None = None,
    id_col: str = "doc_id",
    group_col: str = "lang",
) -> DataFrame:
    """``doc_id, leaf, other, subroot, root, proof`` for every row: digests as binary, proof as (left, right) per level.

    Leaves of a group ascend by id and form a tree of FANOUT children a node; the tops of the groups, in the order of
    their names, form the tree above. ``other`` is a second digest per row, computed in the same scan, that takes no part in
    any tree. Texts are read once, where leaves are computed; all else works on digests.

    1. Leaves are range-sorted by (group, id, digest) and numbered by counted parts, then eight at a time become a run.
    2. Each level is an aggregate over the level below, an eighth of its rows.
    3. Runs and all nodes above hold pointers, which jump (``_paths``); a leaf adds the siblings of its run.

    Null ids come before all others, null groups before all names. Rows with one id stand in the order of their digests.
    A group of one leaf has that leaf as its top. An incomplete last run is hashed as it is, be it one node. Null
    and empty values differ. No rows in, no rows out. Other columns are ignored.
    """
    spark = df.sparkSession
    second = F.lit(None).cast("binary") if other is None else other
    hashed = df.select(
        F.col(group_col).alias("name"), F.col(id_col).alias("doc_id"), leaf.alias("leaf"), second.alias("other")
    )
    leaves = settle(hashed.withColumn("row", F.monotonically_increasing_id()), "merkle_leaves")
    placed, sizes = _positions(leaves, ["name"], ["doc_id", "leaf", "row"], "merkle_order")
    trees, counted = _positions(sizes, [], ["name"], "merkle_trees")
    total = counted.first()["size"]
    if not total:
        return spark.createDataFrame(
            [], f"doc_id bigint, leaf binary, other binary, subroot binary, root binary, proof {_SEGMENT}"
        )
    trees = settle(trees.select(F.col("name").alias("_name"), F.col("pos").alias("tree"), "size"), "merkle_sizes")
    largest = trees.agg(F.max("size")).first()[0]
    member = F.struct("pos", "doc_id", "leaf", "other")
    runs = (
        placed.join(trees, F.col("name").eqNullSafe(F.col("_name")))
        .groupBy("tree", F.expr(f"pos div {FANOUT}").alias("run"))
        .agg(F.max("size").alias("size"), F.array_sort(F.collect_list(member)).alias("kids"))
    )
    digests = F.transform("kids", lambda k: k.leaf)
    top = F.when(F.col("size") == 1, F.col("kids")[0].leaf).otherwise(_hash_of(digests))
    runs = settle(runs.withColumn("digest", top), "merkle_runs")
    first = runs.select(
        "tree",
        F.lit(1).alias("level"),
        F.col("run").alias("pos"),
        F.ceil(F.col("size") / FANOUT).cast("long").alias("n"),
        "digest",
    )
    links, tops = _climb(first, -(-largest // FANOUT), "merkle_level")
    subroots = settle(_union([t.where("n = 1") for t in tops]), "merkle_subroots")
    above, peaks = _climb(
        subroots.select(
            F.lit(TOP).cast("long").alias("tree"),
            F.lit(0).alias("level"),
            F.col("tree").alias("pos"),
            F.lit(total).cast("long").alias("n"),
            "digest",
        ),
        total,
        "merkle_top",
    )
    peak = _union([p.where("n = 1") for p in peaks]).first()
    root = (peak["tree"], peak["level"], peak["pos"])
    if total == 1:
        only = subroots.first()
        root = (only["tree"], only["level"], only["pos"])
    inside = [link.withColumn("subroot", F.lit(None).cast("binary")) for link in links]
    if above:
        # The top of a group's tree is a leaf of the tree above, under its own name there.
        entry = above[0].drop("tree", "level").join(
            subroots.select("tree", "level", F.col("tree").alias("pos"), F.col("digest").alias("subroot")), "pos"
        )
        inside.append(entry.withColumn("pos", F.lit(0).cast("long")))
        inside += [link.withColumn("subroot", F.lit(None).cast("binary")) for link in above[1:]]
    named = F.unhex(F.lit(bytes(peak["digest"]).hex()))
    if inside:
        paths = _paths(_union(inside), root).where((F.col("level") == 1) & (F.col("tree") != TOP))
        paths = paths.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "segment", "subroot")
        held = runs.join(paths, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_pos")), "left")
    else:
        held = runs.withColumn("segment", F.lit(None).cast(_SEGMENT)).withColumn("subroot", F.lit(None).cast("binary"))
    none = F.array().cast(_SEGMENT)
    own = F.when(F.col("size") > 1, F.array(_parts_of(F.col("digests"), F.col("i")))).otherwise(none)
    spread = held.select(
        "size", "segment", "subroot", digests.alias("digests"), F.posexplode("kids").alias("i", "kid")
    )
    return spread.select(
        "kid.doc_id",
        "kid.leaf",
        "kid.other",
        F.coalesce("subroot", named).alias("subroot"),
        named.alias("root"),
        F.concat(own, F.coalesce("segment", none)).alias("proof"),
    )
