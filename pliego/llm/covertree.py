"""Pairs of vectors within an angle, by dual traversal of cover trees.

Unit vectors have cosine >= c exactly if their distance is at most sqrt(2 - 2c), and distances obey
the triangle inequality. Equal vectors form a class, of which one goes on.

Few vectors, or vectors of few dimensions: classes are dealt to cells around pivots, and cells to blocks of
bounded size; two blocks meet unless the distance of their pivots, less their radii, is above the threshold.

Many vectors of many dimensions: no pivot says much about their distances, and all blocks would meet. So each
class goes to one cone in each of a number of tables: the one around the nearest of a table's random axes
(two or more sets of axes, if there are many vectors). Two vectors at the threshold share a table's cone with a
probability that is computed from cosine and dimension; there are so many tables that a pair shares none with a
probability of MISS at most. A pair counts in the first table only in which it shares a cone. The work for a
vector grows with the number of tables, which follows the logarithm of the input.

A task takes two blocks, or one cone, builds nested levels of
centres with halving radii over each, up to one root, and walks both trees from their roots at once: a
pair of nodes is dropped if all its pairs are too far, counted whole if all are near enough, and opened
otherwise. Levels that would merge next to nothing are left out, so vectors without any structure hang
on the root, and opening it compares them all. Only counts and a
forest of links leave a task, never pairs, so a dense group costs no more rows than members.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pliego.llm import words as W
from pliego.llm.common import components, cut, written

BLOCK, CELLS, SAMPLE = 8192, 512, 4096
#: Radii of the nested levels below the root, finest first.
RADII = (0.125, 0.25, 0.5, 1.0)
#: Bound on what single precision adds to a distance of unit vectors near the thresholds here.
SLACK = 2e-3
#: From so many dimensions on, more than BLOCK vectors are dealt to cones of about CONE vectors, on up to AXES axes a set.
WIDE, CONE, AXES = 16, 1024, 64
#: Probability that a pair just at the threshold shares no cone.
MISS = 1e-9
#: Vectors of one task, and bytes of vectors that one round of tables moves besides twice the input.
TASK, ROUND = 65_536, 150_000_000


def normed(matrix: np.ndarray) -> np.ndarray:
    """The unit vectors of rows without a zero or non-finite one."""
    unit = matrix / np.abs(matrix).max(1)[:, None]
    return unit / np.sqrt((unit * unit).sum(1))[:, None]


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Of each list of doubles: whether it can link at all, a hash of it, and the unit vector as bytes."""
    count = len(column)
    can, keys, out = np.zeros(count, bool), np.zeros(count, np.int64), [None] * count
    places = column.offsets.to_numpy().astype(np.int64)
    sizes = np.where(np.asarray(column.is_valid()), np.diff(places), 0)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        matrix = values[places[rows][:, None] + np.arange(dim)]
        size = np.abs(matrix).max(1)
        good = np.isfinite(size) & (size > 0)
        rows, matrix = rows[good], np.ascontiguousarray(matrix[good])
        unit = normed(matrix)
        starts = np.arange(len(rows)) * dim * 8
        can[rows], keys[rows] = True, W.signed(W.hashes(matrix.view(np.uint8).ravel(), starts, starts + dim * 8))
        for i, v in zip(rows.tolist(), unit, strict=True):
            out[i] = v.tobytes()
    return can, keys, out


def classes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, key and unit (doubles as binary) of each row; key and unit are null for vectors that link with nothing."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            can, keys, found = units(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.int64(), mask=~can), pa.array(found, pa.binary())], names=["vec_id", "key", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(work, "vec_id long, key long, unit binary")


def width(vectors: DataFrame) -> int:
    """Bytes that hold a component of `vectors` exactly."""
    kind = vectors.schema["embedding"].dataType
    return 4 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else 8


def keyed(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id, key and raw (the components in `size` bytes each) of each row; key and raw are null for vectors that link with nothing."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = classes_batch(batch)
            raw = [None if u is None else np.asarray(v, f"<f{size}").tobytes() for u, v in zip(packed[1], batch.column("embedding").to_numpy(zero_copy_only=False), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed[0], pa.array(raw, pa.binary())], names=["vec_id", "key", "raw"])

    def classes_batch(batch: pa.RecordBatch) -> tuple[pa.Array, list[bytes | None]]:
        can, keys, found = units(batch.column("embedding"))
        return pa.array(keys, pa.int64(), mask=~can), found

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(work, "vec_id long, key long, raw binary")


def opened_units(classes: DataFrame, size: int) -> DataFrame:
    """key, n and unit (doubles as binary) of classes with raw vectors."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [normed(np.frombuffer(r, f"<f{size}").astype(np.float64)[None])[0].tobytes() for r in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(made, pa.binary())], names=["key", "n", "unit"])

    return classes.select("key", "n", "raw").mapInArrow(work, "key long, n long, unit binary")


def pivots(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Up to `count` vectors far from each other, by dimension, of the SAMPLE classes with the smallest hashes.

    Each dimension of the sample has pivots in proportion to its vectors, one at least.
    """
    got = classes.select("key", "unit").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    out = {}
    for dim in {len(r.unit) // 8 for r in got}:
        points = np.array([np.frombuffer(r.unit, np.float64) for r in got if len(r.unit) == dim * 8])
        chosen, nearest = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < count * len(points) // len(got) and nearest.max() > 1e-9:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.linalg.norm(points - points[chosen[-1]], axis=1))
        out[dim] = points[chosen]
    return out


def blocks_of(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each class's block, and the radius of each block. Vectors of one cell have one dimension."""
    total = classes.count()
    centers = pivots(classes, max(1, min(CELLS, total // BLOCK)))
    first = dict(zip(sorted(centers), np.cumsum([0, *(len(centers[d]) for d in sorted(centers))]).tolist(), strict=False))
    shared = classes.sparkSession.sparkContext.broadcast((centers, first))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = shared.value
        for batch in batches:
            packed = batch.column("unit").to_pylist()
            sizes = np.array([len(u) // 8 for u in packed], np.int64)
            cells, far = -sizes, np.full(len(sizes), 2.0)  # a dimension that the sample lacks: a cell of its own
            for dim in np.unique(sizes).tolist():
                if dim in own:
                    rows = np.flatnonzero(sizes == dim)
                    points = np.frombuffer(b"".join(packed[i] for i in rows.tolist()), np.float64).reshape(-1, dim)
                    near = points @ own[dim].T
                    cells[rows] = near.argmax(1) + number[dim]
                    far[rows] = np.sqrt(np.maximum(2 - 2 * near.max(1), 0)) + 1e-7
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), batch.column("unit"), pa.array(cells, pa.int32()), pa.array(far)], names=["key", "n", "unit", "cell", "far"])

    placed = classes.select("key", "n", "unit").mapInArrow(assign, "key long, n long, unit binary, cell int, far double")
    dealt = cut(placed)
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK)).cast("int")
    placed = cut(dealt.join(sizes, "cell").select("key", "n", "unit", "cell", "far", part.alias("part")))
    return placed, placed.groupBy("cell", "part").agg(F.max("far").alias("radius"))


def block_pairs(blocks: DataFrame, placed: DataFrame, reach: float) -> DataFrame:
    """Pairs (cell, part, other_cell, other_part), each once, whose bounds don't rule a link out."""
    gaps = blocks.sparkSession.createDataFrame(_gaps(placed, reach), "cell int, other_cell int, gap double")
    near = blocks.join(gaps, "cell")
    other = blocks.select(F.col("cell").alias("other_cell"), F.col("part").alias("other_part"), F.col("radius").alias("other_radius"))
    pairs = near.join(other, "other_cell").where(F.struct("cell", "part") <= F.struct(F.col("other_cell").alias("cell"), F.col("other_part").alias("part")))
    return pairs.where(F.col("gap") - F.col("radius") - F.col("other_radius") <= reach + 1e-9).select("cell", "part", "other_cell", "other_part")


def _gaps(placed: DataFrame, reach: float) -> list[tuple[int, int, float]]:
    """Cells that may hold a link (CELLS at most, and one for each dimension that the sample lacked), with lower bounds on the distance of their pivots.

    The bounds come from the classes nearest to the pivots, less their distances to them.
    """
    rows = placed.groupBy("cell").agg(F.min(F.struct("far", "key", "unit")).alias("m"), F.max("far").alias("radius")).collect()
    found = [(r.cell, r.cell, 0.0) for r in rows]
    for dim in {len(r.m.unit) for r in rows}:
        own = [r for r in rows if len(r.m.unit) == dim]
        points = np.array([np.frombuffer(r.m.unit, np.float64) for r in own])
        off, radius = np.array([r.m.far for r in own]), np.array([r.radius for r in own])
        gap = np.sqrt(np.maximum(2 - 2 * (points @ points.T), 0)) - 1e-7 - off[:, None] - off[None]
        for i, j in zip(*(x.tolist() for x in np.nonzero(gap - radius[:, None] - radius[None] <= reach + 1e-9)), strict=True):
            if i != j:
                found.append((own[i].cell, own[j].cell, max(0.0, float(gap[i, j]))))
    return found


class Tree:
    """Nested levels of centres over the rows of one block, from the points (level 0) to one root."""

    def __init__(self, points: np.ndarray):
        self.points, self.light = points, points.astype(np.float32)
        self.nodes, self.radius, self.children = [np.arange(len(points))], [np.zeros(len(points))], [[]]
        self.leaves = [[np.array([i]) for i in range(len(points))]]
        for radius in RADII:
            below = self.nodes[-1]
            if len(below) > 1 and merges(self.light[below], radius):
                self._level(cover(points[below], radius))
        self._level(np.zeros(len(self.nodes[-1]), np.int64))

    def _level(self, owner: np.ndarray) -> None:
        """A level of the nodes that own those below."""
        below = self.nodes[-1]
        order = np.argsort(owner, kind="stable")
        heads, start = np.unique(owner[order], return_index=True)
        groups = np.split(order, start[1:])
        under = [np.concatenate([self.leaves[-1][c] for c in g]) for g in groups]
        self.nodes.append(below[heads])
        self.children.append(groups)
        self.leaves.append(under)
        self.radius.append(np.array([np.sqrt(np.maximum(((self.points[u] - self.points[below[h]]) ** 2).sum(1), 0)).max() for h, u in zip(heads, under, strict=True)]))


def merges(light: np.ndarray, radius: float) -> bool:
    """Whether a level of this radius is worth while: of some points spread over all, each has a hundredth of all within it on average.

    Where fewer are near, a product of matrices finds them faster. Levels of wide nodes that hold a few points each rule nothing out.
    """
    some = light[:: max(1, len(light) // 64)]
    return bool(((some @ light.T >= 1 - radius * radius / 2).sum(1) - 1).mean() >= len(light) / 100)


def cover(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the centre within `radius` that covers it; centres are points that none before them covers."""
    light = points.astype(np.float32)
    bound = np.float32(1 - (radius * radius) / 2)
    owner = np.full(len(points), -1)
    centers: list[int] = []
    for start in range(0, len(points), 256):
        part = light[start : start + 256]
        got = np.full(len(part), -1)
        if centers:
            near = part @ light[centers].T
            best = near.argmax(1)
            hit = near[np.arange(len(part)), best] >= bound
            got[hit] = np.array(centers)[best[hit]]
        inside = part @ part.T
        for i in np.flatnonzero(got < 0):
            if got[i] < 0:
                centers.append(start + int(i))
                take = (got < 0) & (inside[i] >= bound)
                take[i] = True
                got[take] = start + i
        owner[start : start + 256] = got
    return owner


def traverse(one: Tree, two: Tree, cosine: float, same: bool, weight: np.ndarray, other_weight: np.ndarray, earlier: Earlier | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], int]:
    """Numbers of links of each point, a forest of links (places in `two` are counted on from `one`) and how many pairs of points were looked at.

    With `earlier` (of one tree with itself), pairs that it knows are left out.
    """
    reach = math.sqrt(2 - 2 * cosine)
    counts, other_counts = np.zeros(len(one.points), np.int64), np.zeros(len(two.points), np.int64)
    parent = np.arange(len(one.points) + (0 if same else len(two.points)))
    shift = 0 if same else len(one.points)
    forest: list[tuple[int, int]] = []
    visited = 0

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def tie(a: int, b: int) -> None:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            forest.append((a, b))

    def whole(a: np.ndarray, b: np.ndarray) -> None:
        """All of a is linked with all of b."""
        if earlier is not None:
            if not unknown(a, b):
                return
        else:
            counts[a] += other_weight[b].sum()
            (counts if same else other_counts)[b] += weight[a].sum()
        for i in a.tolist():
            tie(i, int(b[0]) + shift)
        for i in b.tolist():
            tie(int(a[0]), i + shift)

    def within(a: np.ndarray) -> None:
        """All of a are linked with each other."""
        if earlier is None:
            counts[a] += weight[a].sum() - weight[a]
        elif not unknown(a, a):
            return
        for i in a[1:].tolist():
            tie(int(a[0]), i)

    def unknown(a: np.ndarray, b: np.ndarray) -> bool:
        """Count the links of two linked sets of points (or of one set with itself) that weren't known before; whether there are any."""
        some = False
        for start in range(0, len(a), 1024):
            part = a[start : start + 1024]
            for begin in range(0, len(b), 1024):
                other = b[begin : begin + 1024]
                new = earlier.block(part, other)
                if a is b:
                    new &= part[:, None] != other[None]
                else:
                    counts[other] += weight[part] @ new
                counts[part] += new @ weight[other]
                some = some or bool(new.any())
        return some

    def step(level: int, lower: int, u: np.ndarray, v: np.ndarray, distance: np.ndarray) -> None:
        """Pairs of nodes of given levels, with their distances."""
        nonlocal visited
        if level == 0 and lower == 0:
            visited += len(u)
        slack = one.radius[level][u] + two.radius[lower][v]
        near = distance - slack <= reach + SLACK
        u, v, distance, slack = u[near], v[near], distance[near], slack[near]
        if not len(u):
            return
        if level == 0 and lower == 0:
            hit = (one.points[u] * two.points[v]).sum(1) >= cosine
            u, v = u[hit], v[hit]
            if same:
                off = u < v
                u, v = u[off], v[off]
            if earlier is not None and len(u):
                new = earlier.pairs(u, v)
                u, v = u[new], v[new]
            np.add.at(counts, u, other_weight[v])
            np.add.at(counts if same else other_counts, v, weight[u])
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                tie(a, b + shift)
            return
        inside = distance + slack <= reach - SLACK
        if same:
            inside &= u != v
        for a, b in zip(u[inside].tolist(), v[inside].tolist(), strict=True):
            if not same or a < b:
                whole(one.leaves[level][a], two.leaves[lower][b])
        u, v = u[~inside], v[~inside]
        if same:
            dense = (u == v) & (2 * one.radius[level][u] <= reach - SLACK)
            for a in u[dense].tolist():
                within(one.leaves[level][a])
            u, v = u[~dense], v[~dense]
            keep = u <= v
            u, v = u[keep], v[keep]
        # open both nodes, a bounded number of pairs at a time
        down, down2 = max(level - 1, 0), max(lower - 1, 0)
        kids = [one.children[level][a] if level else np.array([a]) for a in u]
        kids2 = [two.children[lower][b] if lower else np.array([b]) for b in v]
        buffer: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for same_node, x, y in zip(((u == v) & same).tolist(), kids, kids2, strict=True):
            if len(x) * len(y) > 4096:
                product(down, down2, x, y, same_node)
                continue
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            if same_node:
                a, b = a[a <= b], b[a <= b]
            elif same:
                a, b = np.minimum(a, b), np.maximum(a, b)
            buffer.append((a, b))
            held += len(a)
            if held > 200_000:
                opened(down, down2, buffer)
                buffer, held = [], 0
        if buffer:
            opened(down, down2, buffer)

    def opened(level: int, lower: int, buffer: list[tuple[np.ndarray, np.ndarray]]) -> None:
        a, b = (np.concatenate(x) for x in zip(*buffer, strict=True))
        d = np.sqrt(((one.points[one.nodes[level][a]] - two.points[two.nodes[lower][b]]) ** 2).sum(1))
        step(level, lower, a, b, d)

    def product(level: int, lower: int, x: np.ndarray, y: np.ndarray, same_node: bool) -> None:
        """Many children of two nodes: bounds by a product of matrices first."""
        nonlocal visited
        left, right = one.light[one.nodes[level][x]], two.light[two.nodes[lower][y]]
        wide, wide2 = one.radius[level][x], two.radius[lower][y]
        flat = not wide.any() and not wide2.any()
        for start in range(0, len(x), 512):
            skip = start if same_node else 0  # of a node with itself one triangle
            bound = reach + SLACK + (0 if flat else wide[start : start + 512, None] + wide2[None, skip:])
            i, j = np.nonzero(left[start : start + 512] @ right[skip:].T >= 1 - np.minimum(bound, 2.0) ** 2 / 2 - 1e-6)
            if level == 0 and lower == 0:
                visited += min(512, len(x) - start) * (len(y) - skip) - len(i)
            a, b = x[i + start], y[j + skip]
            if same_node:
                a, b = a[a <= b], b[a <= b]
            elif same:
                a, b = np.minimum(a, b), np.maximum(a, b)
            for part in range(0, len(a), 200_000):
                opened(level, lower, [(a[part : part + 200_000], b[part : part + 200_000])])

    start = np.zeros(1, np.int64)
    opened(len(one.nodes) - 1, len(two.nodes) - 1, [(start, start)])
    return counts, other_counts, forest, visited


def links(placed: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """Partial results of all tasks: rows (key, n_links, null) and forest rows (key, 0, other key)."""
    both = F.array(F.struct(F.col("cell"), F.col("part")), F.struct(F.col("other_cell").alias("cell"), F.col("other_part").alias("part")))
    dealt = pairs.select("cell", "part", "other_cell", "other_part", F.explode(F.array_distinct(both)).alias("block"))
    dealt = dealt.select(F.struct("cell", "part", "other_cell", "other_part").alias("pair"), F.col("block.cell").alias("c"), F.col("block.part").alias("p"))
    rows = placed.join(dealt, (F.col("cell") == F.col("c")) & (F.col("part") == F.col("p"))).select("pair", ((F.col("cell") == F.col("pair.cell")) & (F.col("part") == F.col("pair.part"))).alias("first"), "key", "n", "unit")
    ordered = rows.repartition("pair").sortWithinPartitions("pair", "key")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, ([], [])

        def close() -> pa.RecordBatch | None:
            one, two = group
            if not one:
                return None
            keys = np.array([k for k, _, _ in one + two], np.int64)
            same = not two
            left = Tree(np.array([np.frombuffer(u, np.float64) for _, _, u in one]))
            right = left if same else Tree(np.array([np.frombuffer(u, np.float64) for _, _, u in two]))
            weight = np.array([n for _, n, _ in one], np.int64)
            other = weight if same else np.array([n for _, n, _ in two], np.int64)
            counts, others, forest, _ = traverse(left, right, cosine, same, weight, other)
            found = counts if same else np.concatenate([counts, others])
            some = np.flatnonzero(found)
            a = np.array([x for x, _ in forest], np.int64)
            b = np.array([y for _, y in forest], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([keys[some], keys[a]])), pa.array(np.concatenate([found[some], np.zeros(len(a), np.int64)])), pa.array(np.concatenate([keys[some], keys[b]]), mask=np.arange(len(some) + len(a)) < len(some))],
                names=["key", "n_links", "other"],
            )

        for batch in batches:
            for pair, first, key, n, unit in zip(*(batch.column(c).to_pylist() for c in ("pair", "first", "key", "n", "unit")), strict=True):
                if pair != now:
                    if done := close():
                        yield done
                    now, group = pair, ([], [])
                group[0 if first else 1].append((key, n, unit))
        if done := close():
            yield done

    return ordered.mapInArrow(work, "key long, n_links long, other long")


@lru_cache(maxsize=64)
def shared_cone(cosine: float, dim: int, axes: int) -> float:
    """A lower bound on the probability that two vectors of this cosine have the same nearest one of `axes` random orthogonal axes and their opposites.

    From 100,000 random pairs, less four standard errors. Only places on the axes are drawn, and what the other dimensions add to lengths and products.
    """
    rng, count, rest = np.random.default_rng(17), 100_000, dim - axes
    x, w = (rng.standard_normal((count, axes), dtype=np.float32) for _ in range(2))
    far, along, across = rng.chisquare(rest, count) if rest else np.zeros(count), rng.standard_normal(count) * (rest > 0), rng.chisquare(rest - 1, count) if rest > 1 else np.zeros(count)
    size, other, inner = (x * x).sum(1) + far, (w * w).sum(1) + along**2 + across, (x * w).sum(1) + np.sqrt(far) * along
    share = inner / size
    z = (w - share[:, None] * x) / np.sqrt(np.maximum(other - share * inner, 1e-12))[:, None]
    x = x / np.sqrt(size)[:, None]
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    place = np.arange(count)
    a, b = np.abs(x).argmax(1), np.abs(y).argmax(1)
    found = float(((a == b) & (x[place, a] * y[place, a] > 0)).mean())
    return found - 4 * math.sqrt(found * (1 - found) / count)


def axes_of(count: int, dim: int, cosine: float) -> list[list[np.ndarray]]:
    """For each table its sets of axes, as whole numbers (so that a vector has the same cone wherever it is computed)."""
    sets, cones, shared = [], count / CONE, 1.0
    while cones > 1:
        sets.append(max(1, min(AXES, dim, math.ceil(cones / 2))))
        cones /= 2 * sets[-1]
        shared *= shared_cone(cosine, dim, sets[-1])
    tables = math.ceil(math.log(MISS) / math.log1p(-shared)) if sets else 1
    rng = np.random.default_rng(dim)
    return [[np.rint(2048 * np.linalg.qr(rng.standard_normal((dim, axes)))[0]).astype(np.float32) for axes in sets] for _ in range(tables)]


def cones(whole: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
    """The cone of each vector in one table. `whole`: unit vectors by 2048, rounded; all sums are whole numbers under 2**24, so exact."""
    out, rows = np.zeros(len(whole), np.int64), np.arange(len(whole))
    for axes in table:
        along = whole @ axes
        at = np.abs(along).argmax(1)
        out = out * (2 * axes.shape[1]) + 2 * at + (along[rows, at] > 0)
    return out


def rounded(points: np.ndarray) -> np.ndarray:
    return np.rint(2048 * points).astype(np.float32)


class Earlier:
    """Which pairs of points share a cone in an earlier table."""

    def __init__(self, points: np.ndarray, tables: list[list[np.ndarray]]):
        self.points, self.tables = points, tables

    def pairs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether a pair shares none."""
        left = np.arange(len(u))
        for table in self.tables:  # most pairs that share a cone now did so in the first few tables
            if not len(left):
                break
            members, place = np.unique(np.concatenate([u[left], v[left]]), return_inverse=True)
            found = cones(rounded(self.points[members]), table)[place]
            left = left[found[: len(left)] != found[len(left) :]]
        new = np.zeros(len(u), bool)
        new[left] = True
        return new

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`pairs` of all of a with all of b."""
        new = np.ones((len(a), len(b)), bool)
        one, two = rounded(self.points[a]), rounded(self.points[b])
        for table in self.tables:
            new &= cones(one, table)[:, None] != cones(two, table)[None]
            if not new.any():
                break
        return new


def cone_links(classes: DataFrame, count: int, dim: int, size: int, cosine: float) -> DataFrame:
    """As `links`, of `count` classes with raw vectors of one dimension, over all tables of cones."""
    tables = axes_of(count, dim, cosine)
    shared = classes.sparkSession.sparkContext.broadcast(tables)
    parts = max(1, -(-count // TASK))
    step = max(2, ROUND // (count * (dim * size + 24)))
    found = None
    for start in range(0, len(tables), step):
        chosen = list(range(start, min(start + step, len(tables))))
        made = cut(_cone_round(classes, shared, chosen, parts, dim, size, cosine))
        found = made if found is None else found.unionByName(made)
    return found


def _cone_round(classes: DataFrame, shared, chosen: list[int], parts: int, dim: int, size: int, cosine: float) -> DataFrame:
    """The links found first in the chosen tables. Vectors travel in packs, one for each table and part of its cones."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = W.raw(batch.column("raw"))[0].view(f"<f{size}").reshape(-1, dim)
            keys, counts = (batch.column(c).to_numpy() for c in ("key", "n"))
            whole = rounded(normed(raw.astype(np.float64)))
            for t in chosen:
                cone = cones(whole, shared.value[t])
                part = (W.mix(cone.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                heads = np.flatnonzero(np.diff(part[order], prepend=-1))
                packs = [order[i:j] for i, j in zip(heads, [*heads[1:], len(order)], strict=True)]
                columns = [pa.array([x[p].tobytes() for p in packs], pa.binary()) for x in (keys, counts, cone, raw)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packs), t, np.int32)), pa.array(part[order[heads]].astype(np.int32)), *columns], names=["tab", "part", "keys", "counts", "cones", "raws"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, counts, cone = (np.concatenate([np.frombuffer(h[i], np.int64) for h in held]) for i in range(3))
            raw = np.concatenate([np.frombuffer(h[3], f"<f{size}").reshape(-1, dim) for h in held])
            held.clear()
            order = np.lexsort((keys, cone))
            heads = np.flatnonzero(np.diff(cone[order], prepend=-1))
            nodes, sums, others = [], [], []
            for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
                if j - i < 2:
                    continue
                own = order[i:j]
                points, weight = normed(raw[own].astype(np.float64)), counts[own]
                tree = Tree(points)
                linked, _, forest, _ = traverse(tree, tree, cosine, True, weight, weight, Earlier(points, shared.value[: now[0]]))
                some = np.flatnonzero(linked)
                ties = np.array(forest, np.int64).reshape(-1, 2)
                nodes += [keys[own[some]], keys[own[ties[:, 0]]]]
                sums += [linked[some], np.zeros(len(ties), np.int64)]
                others += [pa.nulls(len(some), pa.int64()), pa.array(keys[own[ties[:, 1]]])]
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sums)), pa.concat_arrays(others)], names=["key", "n_links", "other"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("tab", "part", "keys", "counts", "cones", "raws")), strict=True):
                if (pair := (row[0].as_py(), row[1].as_py())) != now:
                    yield from close()
                    now = pair
                held.append([x.as_buffer() for x in row[2:]])
        yield from close()

    packs = classes.select("key", "n", "raw").mapInArrow(deal, "tab int, part int, keys binary, counts binary, cones binary, raws binary")
    dealt = packs.repartition(len(chosen) * parts, "tab", "part").sortWithinPartitions("tab", "part")
    return dealt.mapInArrow(compare, "key long, n_links long, other long")


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of `vectors` (vec_id, embedding).

    Vectors of the same dimension are linked if their cosine in double precision is at least `cosine`. Of more than BLOCK
    different vectors of WIDE dimensions or more, a pair just at `cosine` is missed with a probability of MISS at most.
    n_links counts the other rows linked directly, copies included; component_id is the smallest vec_id
    reachable; kept says whether it is the row's own. Vectors that are null, empty or zero, or hold null
    or non-finite components, have no links.
    """
    size = width(vectors)
    made = keyed(vectors, size)
    rows = written(made.select("vec_id", "key"))
    classes = written(made.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("raw").alias("raw")))
    dims = {r.dim: r["count"] for r in classes.groupBy((F.octet_length("raw") / size).cast("int").alias("dim")).count().collect()}
    many = sorted(d for d, count in dims.items() if d >= WIDE and count > BLOCK)
    parts = [cone_links(classes.where(F.octet_length("raw") == d * size), dims[d], d, size, cosine) for d in many]
    if len(many) < len(dims) or not dims:
        placed, blocks = blocks_of(opened_units(classes.where(~F.octet_length("raw").isin([d * size for d in many])), size))
        parts.append(links(placed, block_pairs(cut(blocks), placed, math.sqrt(2 - 2 * cosine)), cosine))
    found = cut(reduce(DataFrame.unionByName, parts))
    counts = found.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    groups = components(found.where("other is not null"), "key", "other")
    named = classes.select("key", "vec_id").join(groups.withColumnRenamed("node", "key"), "key")
    least = named.groupBy("component").agg(F.min("vec_id").alias("least"))
    per_class = (
        classes.select("key", "vec_id", "n")
        .join(named.join(least, "component").select("key", "least"), "key", "left")
        .join(counts, "key", "left")
        .select("key", F.coalesce("least", "vec_id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    joined = rows.select("vec_id", "key").join(per_class, "key", "left")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
