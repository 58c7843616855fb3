"""Near-duplicate vectors by dual traversal of cover trees.

Within a label, vectors are scaled to length 1, so a cosine threshold is a distance bound. A label with more vectors than a block holds is divided into cells around pivots,
and so is every cell that is still too large, until cells fit; each cell keeps its pivot and the radius that covers it. These cells are an upper tree, which is traversed with itself
level by level: two cells go on to their children only if their balls come near enough. Every block at the end gets a cover tree of its own, built once: nested levels whose radii halve, down to
leaves of a few vectors, every node with the radius that covers what is below it. The trees of blocks that meet are traversed together: a pair of nodes is dropped once the distance
of its centers exceeds both radii and the bound, and two leaves are compared by one matrix product. What is left are the exact threshold pairs, of which a comparison
returns link counts and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

BLOCK = 2048  # vectors of a block, about
PIVOTS = 64  # of a cell, at most
ROWS = 8192  # of a cell that one task deals out
LEAF = 24  # vectors that aren't split further
FINEST = 2.0**-16  # points that are nearer to each other are not split by further levels
SLACK = 1e-6  # for rounding, in distances; only bounds use it


class CoverTree:
    """A tree over `points` of length 1, which it puts into the order of its leaves: node u covers points[low[u]:high[u]] with a ball around points[center[u]].

    Levels are nested: the children of a node cover a radius of half its own each, and the first of them keeps its center. Node 0 is the root.
    """

    def __init__(self, points: np.ndarray):
        far = np.sqrt(np.maximum(0.0, 2 - 2 * (points @ points.T)))
        order: list[np.ndarray] = []
        centers, radii, lows, highs, parents = [], [], [], [], []
        placed = 0
        todo = [(np.arange(len(points)), 0, 1.0, -1)]
        while todo:  # depth first, so that the points below a node are neighbours in the order
            own, center, radius, above = todo.pop()
            node = len(centers)
            reach = float(far[center, own].max())
            centers.append(center)
            radii.append(reach)
            lows.append(placed)
            highs.append(placed + len(own))
            parents.append(above)
            while radius >= reach and radius >= FINEST:  # levels on which nothing would split
                radius /= 2
            if len(own) <= LEAF or radius < FINEST:
                order.append(own)
                placed += len(own)
                continue
            left = own
            while len(left):  # the center is its own first child, each other child the first point that isn't covered yet
                near = far[center, left] <= radius
                todo.append((left[near], center, radius / 2, node))
                left = left[~near]
                if len(left):
                    center = int(left[0])
        self.order = np.concatenate(order)
        self.center, self.radius, self.low, self.high, self.parent = np.argsort(self.order)[centers], np.array(radii), np.array(lows), np.array(highs), np.array(parents)
        self._use(points[self.order])

    def _use(self, points: np.ndarray) -> None:
        """`points` in the order of the leaves."""
        self.points, self.centers = points, points[self.center]
        below = np.argsort(self.parent, kind="stable")
        at = np.searchsorted(self.parent[below], np.arange(len(self.parent) + 1))
        self.children = [below[i:j] for i, j in zip(at, at[1:])]

    @classmethod
    def stored(cls, points: np.ndarray, nodes: np.ndarray, radius: np.ndarray) -> CoverTree:
        """A tree read again, whose points keep the order of its leaves."""
        tree = cls.__new__(cls)
        (tree.center, tree.low, tree.high, tree.parent), tree.radius, tree.order = nodes, radius, np.arange(len(points))
        tree._use(points)
        return tree


def dual(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of `a` and of `b`, by their first places, whose cosine is at least `cosine`; with a tree and itself each pair once, none with itself."""
    same, bound = a is b, math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    left, right, todo = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [(0, 0)]
    while todo:
        u, v = todo.pop()
        one, two = a.children[u], b.children[v]
        if not len(one) and not len(two):
            hit = a.points[a.low[u] : a.high[u]] @ b.points[b.low[v] : b.high[v]].T >= cosine
            if same and u == v:
                hit = np.triu(hit, 1)
            x, y = np.nonzero(hit)
            left.append(a.order[a.low[u] + x])
            right.append(b.order[b.low[v] + y])
            continue
        one, two = one if len(one) else np.array([u]), two if len(two) else np.array([v])
        far = np.sqrt(np.maximum(0.0, 2 - 2 * (a.centers[one] @ b.centers[two].T)))
        near = far <= a.radius[one][:, None] + b.radius[two][None, :] + bound
        if same and u == v:
            near = np.triu(near)
        x, y = np.nonzero(near)
        todo += zip(one[x].tolist(), two[y].tolist())
    return np.concatenate(left), np.concatenate(right)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _dealt(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """`rows` (.., dim, vector, path) below the nearest of their cell's pivots, with the distance `far`."""
    own, to = _unit(_matrix(rows["vector"].combine_chunks(), rows["dim"][0].as_py())), _unit(_matrix(pivots["vector"].combine_chunks(), rows["dim"][0].as_py()))
    far = np.sqrt(np.maximum(0.0, 2 - 2 * (own @ to.T)))
    cell = far.argmin(axis=1)
    names = np.array([f"{pivots['path'][0].as_py()}.{k}" for k in pivots["place"].to_pylist()])
    rows = rows.set_column(rows.schema.get_field_index("path"), "path", pa.array(names[cell], pa.string()))
    return rows.drop_columns(["group"]).append_column("far", pa.array(far[np.arange(len(cell)), cell]))


def divided(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """`rows` (path, dim, rep, mult, vector) with the path of the block that each ends in, the tree of cells, and its depth.

    The tree has a row (parent, child, center, radius, leaf) for each cell and block below the first paths, and one of itself below each leaf.
    A cell that pivots hardly divide, as its vectors are nearly one, is dealt into blocks by hash; so all blocks end.
    """
    kind = rows.schema["vector"].dataType.simpleString()
    fields = ["path", "dim", "rep", "mult", "vector"]
    sizes = cut(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")))
    leaf = lambda p, center, radius: p.select(F.col("path").alias("parent"), F.col("path").alias("child"), center.alias("center"), radius.alias("radius"), F.lit(True).alias("leaf"))
    none = F.lit(None).cast("array<double>")
    tree = [leaf(sizes.where(F.col("n") <= block), none, F.lit(0.0))]
    small = sizes.where(F.col("n") <= block).select("path")
    done, open_ = [rows.join(small, "path", "left_semi").select(fields)], sizes.where(F.col("n") > block)
    depth = 0
    while not open_.isEmpty():
        depth += 1
        here = rows.join(open_, "path")
        want = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / block) * 2)
        spread = here.where(F.pmod(F.xxhash64("rep", F.lit(depth)), F.col("n")) < want * 4 + 8)
        ranked = spread.groupBy("path", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("rep", F.lit(-depth)).alias("h"), "vector"))), 1, PIVOTS).alias("p"))
        pivots = cut(ranked.select("path", "n", F.posexplode(F.slice("p", F.lit(1), want.cast("int"))).alias("place", "x")).select("path", "n", "place", F.col("x.vector").alias("vector")))
        parts = F.ceil(F.col("n") / ROWS).cast("int")
        group = lambda salt: F.concat_ws("#", "path", salt)
        data = here.withColumn("group", group(F.pmod(F.xxhash64("rep"), parts))).select("group", *fields)
        copies = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).select(group(F.col("salt")).alias("group"), *[F.col(c).alias(c) for c in ("path", "place", "vector")])
        schema = f"path string, dim int, rep long, mult long, vector {kind}, far double"
        dealt = cut(data.groupBy("group").cogroup(copies.groupBy("group")).applyInArrow(_dealt, schema))
        cells = dealt.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).withColumn("parent", F.regexp_extract("path", "^(.*)[.]", 1))
        cells = cells.join(pivots.select(F.concat_ws(".", "path", "place").alias("path"), F.col("n").alias("of"), F.col("vector").cast("array<double>").alias("center")), "path")
        scale = F.sqrt(F.aggregate("center", F.lit(0.0), lambda t, x: t + x * x))
        cells = cut(cells.withColumn("scale", scale).withColumn("center", F.transform("center", lambda x: x / F.col("scale"))))
        end, hard = F.col("n") <= block, F.col("n") > 0.9 * F.col("of")
        tree.append(cells.select("parent", F.col("path").alias("child"), "center", "radius", end.alias("leaf")))
        tree.append(leaf(cells.where(end), F.col("center"), F.col("radius")))
        blocks = cells.where(~end & hard).withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1))).withColumn("child", group(F.col("part")))
        tree.append(blocks.select(F.col("path").alias("parent"), "child", "center", "radius", F.lit(True).alias("leaf")))
        tree.append(blocks.select(F.col("child").alias("parent"), "child", "center", "radius", F.lit(True).alias("leaf")))
        done.append(dealt.join(cells.where(end).select("path"), "path", "left_semi").select(fields))
        dense = dealt.join(cells.where(~end & hard).select("path", "n"), "path")
        done.append(dense.withColumn("path", group(F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / block).cast("int")))).select(fields))
        rows, open_ = dealt.select(fields), cells.where(~end & ~hard).select("path", "n")
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[: len(parts) // 2]).unionByName(union(parts[len(parts) // 2 :]))
    return union(done), cut(union(tree)), depth


def meeting(tree: DataFrame, depth: int, bound: float) -> DataFrame:
    """(block, block_): the blocks whose balls come within `bound`, each pair once, and each block with itself. Level by level, from the first paths with themselves."""
    one = tree.select(F.col("parent").alias("block"), *[F.col(c).alias(f"{c}1") for c in ("child", "center", "radius", "leaf")])
    two = tree.select(F.col("parent").alias("block_"), *[F.col(c).alias(f"{c}2") for c in ("child", "center", "radius", "leaf")])
    pairs = tree.select(F.col("parent").alias("block")).where(~F.col("block").contains(".")).distinct().select("block", F.col("block").alias("block_"))
    gap = F.sqrt(F.aggregate(F.zip_with("center1", "center2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    for _ in range(depth + 1 if depth else 0):  # dealt blocks stand one level below their cell
        near = pairs.join(one, "block").join(two, "block_")
        near = near.where((F.col("child1") == F.col("child2")) | (((F.col("block") != F.col("block_")) | (F.col("child1") < F.col("child2"))) & (gap <= F.col("radius1") + F.col("radius2") + bound)))
        pairs = cut(near.select(F.col("child1").alias("block"), F.col("child2").alias("block_")))
    return pairs


_BLOCK = pa.schema([("path", pa.string()), ("dim", pa.int32()), ("reps", pa.list_(pa.int64())), ("mults", pa.list_(pa.int64())), ("points", pa.binary()), ("nodes", pa.binary()), ("radii", pa.binary())])
_BLOCK_SCHEMA = "path string, dim int, reps array<long>, mults array<long>, points binary, nodes binary, radii binary"


def _planted(rows: pa.Table) -> pa.Table:
    """The row of a block: its vectors in the order of the tree's leaves, and the tree."""
    dim = rows["dim"][0].as_py()
    column = rows["vector"].combine_chunks()
    raw = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    tree = CoverTree(_unit(raw))
    at = lambda name: pa.array([rows[name].to_numpy()[tree.order]], pa.list_(pa.int64()))
    nodes = np.stack([tree.center, tree.low, tree.high, tree.parent]).astype(np.int32)
    return pa.Table.from_arrays([rows["path"].slice(0, 1).combine_chunks(), pa.array([dim], pa.int32()), at("rep"), at("mult"), *[pa.array([x.tobytes()], pa.binary()) for x in (raw[tree.order], nodes, tree.radius)]], schema=_BLOCK)


def _meet(cosine: float, single: bool):
    """Columns: block, block_, then dim, reps, mults, points, nodes and radii of each. Vectors are stored as floats if `single`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray, CoverTree]] = {}  # of the last few blocks

        def block(b: pa.RecordBatch, k: int, name: int, c: int) -> tuple[np.ndarray, np.ndarray, CoverTree]:
            path = b.column(name)[k].as_py()
            if path not in held:
                if len(held) >= 4:
                    del held[next(iter(held))]
                dim, points, nodes, radii = b.column(c)[k].as_py(), *[b.column(c + i)[k].as_py() for i in (3, 4, 5)]
                unit = _unit(np.frombuffer(points, np.float32 if single else np.float64).reshape(-1, dim))
                held[path] = *(b.column(c + i)[k].values.to_numpy() for i in (1, 2)), CoverTree.stored(unit, np.frombuffer(nodes, np.int32).reshape(4, -1), np.frombuffer(radii))
            return held[path]

        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for k in range(b.num_rows):
                rep, mult, one = block(b, k, 0, 2)
                if b.column(0)[k].as_py() == b.column(1)[k].as_py():
                    i, j = dual(one, one, cosine)
                else:
                    rep_, mult_, two = block(b, k, 1, 8)
                    i, j = dual(one, two, cosine)
                    j = j + len(rep)
                    rep, mult = np.concatenate([rep, rep_]), np.concatenate([mult, mult_])
                if not len(i):
                    continue
                links = np.bincount(i, weights=mult[j], minlength=len(rep)) + np.bincount(j, weights=mult[i], minlength=len(rep))
                root = np.arange(len(rep))
                while True:
                    new = root.copy()
                    np.minimum.at(new, i, root[j])
                    np.minimum.at(new, j, root[i])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                hit = links > 0
                for o, v in zip(out, (rep[hit], links[hit].astype(np.int64), rep[root[hit]])):
                    o += v.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["rep", "links", "root"])

    return run


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_pairs(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id), a row for each row of `df`.

    Vectors of equal label (null equals nothing) and length are linked if their cosine, in double precision, is at least `cosine`. Equal vectors are one class from the start, and each
    row of it counts; repeated ids are rows of their own. Vectors that are null, zero, or hold null or non-finite components are linked with nothing, nor are rows without id. Labels are
    integers or strings; ids are integers; other columns, whatever their names, are not read. An empty table gives no rows. Nothing is sampled but pivots, which only say what may be near.
    Vectors without any structure have no cells that part, and all blocks of a label meet.
    """
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    keyed = rows.select("vec_id", "label", "ok", F.when(F.col("ok"), F.xxhash64("vector")).alias("k1"), F.when(F.col("ok"), F.xxhash64(F.lit(7), "vector")).alias("k2"), F.when(F.col("ok"), F.size("vector")).alias("dim"), F.col("vector").cast("array<float>" if single else "array<double>").alias("vector"))
    grouped = keyed.where("ok").groupBy("label", "dim", "k1", "k2").agg(F.min(F.col("vec_id").cast("long")).alias("low"), F.count(F.lit(1)).alias("mult"), F.first("vector").alias("vector"))
    reps = cut(grouped.withColumn("rep", F.monotonically_increasing_id()))
    first = cut(reps.select("label", "dim").distinct().withColumn("path", F.monotonically_increasing_id().cast("string")))
    blocks, tree, depth = divided(reps.join(first, ["label", "dim"]).select("path", "dim", "rep", "mult", "vector"), block)
    planted = cut(blocks.groupBy("path").applyInArrow(_planted, _BLOCK_SCHEMA))
    near = meeting(tree, depth, math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK)
    parts = ["dim", "reps", "mults", "points", "nodes", "radii"]
    one = planted.select(F.col("path").alias("block"), *parts)
    two = planted.select(F.col("path").alias("block_"), *[F.col(c).alias(f"{c}_") for c in parts])
    met = near.join(one, "block").join(two, "block_").select("block", "block_", *parts, *[f"{c}_" for c in parts])
    found = cut(met.mapInArrow(_meet(cosine, single), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), reps.select(F.col("rep").alias("node"), "low"))
    classes = classes.select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    of = reps.select("label", "dim", "k1", "k2", "rep", "low", "mult").join(links, "rep", "left").join(classes, "rep", "left")
    of = of.select("label", "dim", "k1", "k2", F.coalesce("component_id", "low").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    joined = keyed.select("vec_id", "label", "dim", "k1", "k2").join(of, ["label", "dim", "k1", "k2"], "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
