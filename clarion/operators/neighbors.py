"""Exact neighbour search (C0) without a cross join: pivot cells and blocks.

* **Cells.**  A few points, the smallest by content hash, are pivots; every point
  belongs to its nearest pivot (a Voronoi cell).
* **Blocks.**  A cell is cut by hash into blocks of about ``BLOCK`` points, so a
  cell that holds a third of all points (equal ones, say) is many blocks.
* **Bounds.**  A block keeps the range of its points' distances to ``REFERENCES``
  pivots.  For any reference p, ``| |xp| - |yp| | <= |xy|``, so the gap between
  two blocks' ranges is a lower bound of all their distances.  Cells are paired
  first, then the blocks of the cells that are left.
* **Search.**  Blocks of neighbouring cells work as a team of some thousand points,
  so a block's vectors travel once per team that needs them, not once per block.
  A block's own points bound the k-th distance from above.  Only
  blocks whose lower bound is within it are met, nearest first, and of a block's
  points only those whose own distances to the references leave room for a
  nearer neighbour.  A radius search meets the blocks within the radius.

Exact whatever the data; how much is compared depends on how well distances to
pivots tell points apart (``compared``).  In few dimensions that is little; for
directions spread evenly over many dimensions any exact search compares nearly
all pairs, and ``knn_probed`` looks only at the blocks of the nearest cells.

Ids are unique.  Vectors have one length and no NULL or NaN.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarion.session import kept

#: Points of a block, and the most pivots (each is a vector that every task holds).
BLOCK, MOST_PIVOTS = 256, 1_024
REFERENCES = 16
#: Blocks of one cell, and the most neighbouring cells, that make a team; teams for each core, however many
#: points there are: every team gets nearly all vectors where nothing can be pruned.
TEAM, MOST_CELLS, TEAMS_A_CORE = 16, 64, 2
#: Distances are rounded: bounds give way by this share of the vectors' size.
SLACK = 1e-9
#: Squares of lengths between which pairs are first told apart in single precision.
SMALL, LARGE = 1e-24, 1e24
PROBES = 8


def euclidean(a, b) -> Column:
    """sqrt(sum_i (a_i - b_i)^2), folded left to right (JVM-side)."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, by rows of x so that few differences are held."""
    out = np.empty((len(x), len(y)))
    step = max(1, 1_000_000 // max(1, y.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.sqrt(((x[i : i + step, None] - y) ** 2).sum(axis=2))
    return out


def _ids(values: pa.Array) -> np.ndarray:
    """Ids in an array that sorts as they do."""
    return values.to_numpy(zero_copy_only=False).astype(str) if pa.types.is_string(values.type) else values.to_numpy(zero_copy_only=False)


class Nearest:
    """The nearest points found so far for the points of a block, ``k`` of each of ``tags`` kinds."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int | None, eps: float, tags: int = 1):
        self.ids, self.v, self.k, self.eps, self.tags = ids, v, k, eps, tags
        self.centre = v.mean(axis=0)
        x = v - self.centre
        self.size = (x ** 2).sum(axis=1)
        self.most = float(self.size.max(initial=0.0))
        self.flat = np.concatenate([-2 * x, np.ones((len(x), 2))], axis=1).astype(np.float32) if SMALL < self.most < LARGE else None
        self.limit = np.full((len(ids), tags), eps)  # distance of the k-th neighbour so far
        self.key, self.nid, self.dist = np.empty(0, np.int64), ids[:0], np.empty(0)  # key: place in the block and kind
        self.waiting, self.unsorted = [], 0
        self.compared = 0

    def meet(self, ids: np.ndarray, v: np.ndarray, tag: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        """Compare the points ``rows`` of the block with all of ``v``."""
        if self.tags == 1 and len(tag) and tag[0] == tag[-1] == 0 and not tag.any():
            return self._meet(ids, v, 0, rows)
        for t in np.unique(tag):
            own = tag == t
            self._meet(ids[own], v[own], int(t), rows)

    def _meet(self, ids: np.ndarray, v: np.ndarray, t: int, rows: np.ndarray | slice) -> None:
        y, limit = v - self.centre, self.limit[rows, t]
        if not len(limit):
            return
        self.compared += len(limit) * len(y)
        other = (y ** 2).sum(axis=1)
        most, far = float(other.max(initial=0.0)), float(limit.max()) ** 2
        if self.flat is not None and most < LARGE and far < LARGE:
            # single precision tells which pairs may be near enough; slack: the most that its products and sums can be wrong
            slack = np.finfo(np.float32).eps * (y.shape[1] + 16) * (2 * (self.most + most) + far)
            x = self.flat[rows].copy()
            x[:, -2] = self.size[rows] - limit ** 2 - slack
            near = x @ np.concatenate([y, np.ones((len(y), 1)), other[:, None]], axis=1).astype(np.float32).T
            hit = near <= 0
        else:
            slack = SLACK * (self.most + most)
            near = self.size[rows, None] + other - 2 * (self.v - self.centre)[rows] @ y.T  # close to the squares of the distances
            hit = near <= (limit ** 2 + slack)[:, None]
        place = np.flatnonzero(hit.ravel())
        if not len(place):
            return
        if self.k is not None and len(place) > 2 * self.k + 1:  # one more than k: a point may be met itself
            many = np.flatnonzero(np.bincount(place // len(y), minlength=len(limit)) > 2 * self.k + 1)
            if len(many):
                hit[many] &= near[many] <= np.partition(near[many], self.k, axis=1)[:, [self.k]] + 2 * slack
                place = np.flatnonzero(hit.ravel())
        row, col = np.divmod(place, len(y))
        row = np.arange(len(self.ids))[rows][row]
        ok = self.ids[row] != ids[col]
        row, col = row[ok], col[ok]
        dist = np.sqrt(((self.v[row] - v[col]) ** 2).sum(axis=1))
        ok = dist <= self.limit[row, t]
        self.waiting.append((row[ok] * self.tags + t, ids[col[ok]], dist[ok]))
        self.unsorted += len(self.waiting[-1][0])
        if self.k is None or self.unsorted > len(self.key) // 4:  # sorted when there are many: until then the limits are only wider
            self.settle()

    def settle(self) -> None:
        """Sort in what was found since the last time."""
        if not self.waiting:
            return
        key, nid, dist = (np.concatenate(p) for p in zip((self.key, self.nid, self.dist), *self.waiting))
        self.waiting, self.unsorted = [], 0
        if self.k is not None:
            order = np.lexsort((nid, dist, key))
            key, nid, dist = key[order], nid[order], dist[order]
            rank = np.arange(len(key)) - np.searchsorted(key, key)
            ok = rank < self.k
            last = rank == self.k - 1
            self.limit.ravel()[key[last]] = dist[last]
            key, nid, dist = key[ok], nid[ok], dist[ok]
        self.key, self.nid, self.dist = key, nid, dist

    def ranks(self) -> np.ndarray:
        return np.arange(len(self.key)) - np.searchsorted(self.key, self.key) + 1

    def forget(self) -> None:
        self.key, self.nid, self.dist = self.key[:0], self.nid[:0], self.dist[:0]


def _pivots(points: DataFrame, n: int) -> np.ndarray:
    """Distinct vectors, the smallest by content hash; at most ``MOST_PIVOTS``."""
    want = min(MOST_PIVOTS, max(1, n // BLOCK))
    rows = points.select("_v").distinct().orderBy(F.xxhash64("_v"), "_v").limit(max(want, REFERENCES)).collect()
    return np.array([r[0] for r in rows])


def _assign(pivots: np.ndarray, want: int):
    """Cells by nearest pivot, numbered so that neighbouring numbers lie near each other."""
    order = [0]
    left = set(range(1, want))
    while left:  # from each pivot to the nearest that is left
        far = np.array(sorted(left))
        order.append(int(far[((pivots[far] - pivots[order[-1]]) ** 2).sum(axis=1).argmin()]))
        left.remove(order[-1])
    ordered = pivots[order] if want else pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _distances(_matrix(b.column("_v")), ordered).argmin(axis=1) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])
    return run, ordered


def _bounded(pivots: np.ndarray, k: int | None, eps: float, tags: int):
    """Of each block: its number, the largest distance that matters and the ranges of distances to the references."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                points = b.column("points")[i].values
                ids, v = _ids(points.field("_id")), _matrix(points.field("_v"))
                d = _distances(v, pivots[:REFERENCES])
                bound = eps
                if k is not None:
                    own = Nearest(ids, v, k, np.inf, tags)
                    own.meet(ids, v, points.field("_t").to_numpy())
                    own.settle()
                    bound = float(own.limit.max())
                slack = SLACK * float(np.abs(d).max() + np.sqrt((v ** 2).sum(axis=1)).max())
                rows.append((len(ids), bound + slack, (d.min(axis=0) - slack).tolist(), (d.max(axis=0) + slack).tolist()))
            n, bound, lo, hi = ([r[j] for r in rows] for j in range(4))
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("block"), pa.array(n, pa.int64()), pa.array(bound, pa.float64()), pa.array(lo, doubles), pa.array(hi, doubles), b.column("points")],
                                             names=["cell", "block", "n", "bound", "lo", "hi", "points"])
    return run


def _gap(a: str, b: str) -> Column:
    """The largest gap between two ranges of distances: no two points are nearer."""
    gaps = F.zip_with(F.arrays_zip(f"{a}.lo", f"{a}.hi"), F.arrays_zip(f"{b}.lo", f"{b}.hi"), lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"]))
    return F.greatest(F.array_max(gaps), F.lit(0.0))


class Blocks:
    """Points in blocks, with bounds: what all searches start from."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, k: int | None, eps: float = float("inf"), tag_col: str | None = None, tags: int = 1):
        tag = F.col(tag_col).cast("int") if tag_col else F.lit(0)
        points = kept(df.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"), tag.alias("_t")), "points")
        self.tags = tags
        self.k, self.eps, self.id_type = k, eps, points.schema["_id"].dataType
        self.n = points.count()
        self.pivots = _pivots(points, self.n)
        want = self.cells = min(MOST_PIVOTS, max(1, self.n // BLOCK), max(1, len(self.pivots)))
        kind = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType())])
        assign, self.centres = _assign(self.pivots, want) if self.n else (_assign(self.pivots, 0)[0], self.pivots)
        celled = kept(points.mapInArrow(assign, kind), "cells")
        sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))  # a row per pivot at most
        block = F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int")
        grouped = celled.join(F.broadcast(sizes), "cell").groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("_id", "_v", "_t")).alias("points"))
        out = T.StructType.fromDDL("cell int, block int, n long, bound double, lo array<double>, hi array<double>").add("points", grouped.schema["points"].dataType)
        self.table = kept(grouped.mapInArrow(_bounded(self.pivots, k, eps, tags), out), "blocks")
        self.refs = min(REFERENCES, len(self.pivots))
        teams = TEAMS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
        self.team_cells = min(MOST_CELLS, -(-want // teams))

    def pairs(self, probes: int | None = None) -> DataFrame:
        """(cell, block, other, other_block, gap) of the blocks to meet; with ``probes`` those of the nearest cells only."""
        at = lambda f, c, i: f(F.col(c)[i])
        cells = self.table.groupBy("cell").agg(
            F.max("bound").alias("bound"), F.array(*[at(F.min, "lo", i) for i in range(self.refs)]).alias("lo"), F.array(*[at(F.max, "hi", i) for i in range(self.refs)]).alias("hi"))
        # at most MOST_PIVOTS cells on each side
        near = cells.alias("x").crossJoin(F.broadcast(cells.alias("y"))).where(_gap("x", "y") <= F.col("x.bound")).select(F.col("x.cell").alias("cell"), F.col("y.cell").alias("other"))
        if probes is not None:
            order = np.argsort(_distances(self.centres, self.centres), axis=1, kind="stable")[:, :probes]
            probed = [(i, int(j)) for i, row in enumerate(order) for j in row]
            near = near.join(F.broadcast(self.table.sparkSession.createDataFrame(probed, "cell int, other int")), ["cell", "other"])
        slim = self.table.drop("points")
        met = near.join(slim.alias("a"), "cell").join(slim.withColumnRenamed("cell", "other").alias("b"), "other")
        return met.withColumn("gap", _gap("a", "b")).where(F.col("gap") <= F.col("a.bound")).select(
            "cell", F.col("a.block").alias("block"), "other", F.col("b.block").alias("other_block"), "gap")

    def _stream(self, probes: int | None) -> DataFrame:
        """A team's blocks, then the other blocks that any of them meets, nearest first."""
        team = lambda cell, block: (F.floor(F.col(cell) / self.team_cells) * (1 << 32) + F.floor(F.col(block) / TEAM)).alias("team")
        data = self.table.select(F.col("cell").alias("other"), F.col("block").alias("other_block"), "lo", "hi", "points")
        met = self.pairs(probes).groupBy(team("cell", "block"), "other", "other_block").agg(F.min("gap").alias("gap"))
        rows = self.table.select(team("cell", "block"), F.lit(-1.0).alias("gap"), "lo", "hi", "points").unionByName(
            met.join(data, ["other", "other_block"]).select("team", "gap", "lo", "hi", "points"))
        return rows.repartition("team").sortWithinPartitions("team", "gap")

    def compared(self) -> float:
        """The share of all ordered pairs of points that an exact search compares."""
        if not self.n:
            return 0.0
        counts = self._stream(None).mapInArrow(_searched(self.pivots[:REFERENCES], self.k, self.eps, self.tags, count=True), "n long")
        return counts.agg(F.sum(F.col("n").cast("double"))).first()[0] / self.n ** 2

    def search(self, probes: int | None = None) -> DataFrame:
        """(id, rank, nid, dist, tag): neighbours of one tag are ranked together."""
        out = T.StructType([T.StructField("id", self.id_type), T.StructField("rank", T.IntegerType()), T.StructField("nid", self.id_type), T.StructField("dist", T.DoubleType()), T.StructField("tag", T.IntegerType())])
        if not self.n:
            return self.table.sparkSession.createDataFrame([], out)
        return self._stream(probes).mapInArrow(_searched(self.pivots[:REFERENCES], self.k, self.eps, self.tags), out)


    def gathered(self, what: str) -> DataFrame:
        """What a team makes of all pairs within the radius, without a row per pair (see ``_gathered``)."""
        first, second = {"counts": ("n", T.LongType()), "links": ("nid", self.id_type), "least": ("label", T.IntegerType())}[what]
        out = T.StructType([T.StructField("id", self.id_type), T.StructField(first, second)])
        if not self.n:
            return self.table.sparkSession.createDataFrame([], out)
        return self._stream(None).mapInArrow(_gathered(self.pivots[:REFERENCES], self.eps, what), out)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place connected with each place, after joining the places ``a`` and ``b``."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _gathered(references: np.ndarray, eps: float, what: str):
    """Of a team's points and all points within the radius of them:

    * ``counts``: (id, n), their number, one row per point;
    * ``links``: (id, nid), edges that connect what the pairs connect: from a point that is met to one of
      its neighbours in the team, and from each point of the team to the least one that pairs connect it with;
    * ``least``: (id, label), for points with a negative tag the least tag of 0 or more around them.
    """
    name = {"counts": "n", "links": "nid", "least": "label"}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, team, kind = None, [], None  # team: (points, distances to the references, tags, place of the first) of each block
        made = np.empty(0, np.int64)

        def rows(ids, values, of) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(values, of)], names=["id", name])

        def told() -> Iterator[pa.RecordBatch]:
            if not team:
                return
            ids = np.concatenate([found.ids for found, *_ in team])
            if what == "counts":
                yield rows(ids, made, pa.int64())
            elif what == "links":
                moved = np.flatnonzero(made != np.arange(len(ids)))
                yield rows(ids[moved], ids[made[moved]], kind)
            else:
                near = np.flatnonzero(made < 2 ** 31)
                yield rows(ids[near], made[near], pa.int32())

        for b in batches:
            for i, (key, gap) in enumerate(zip(b.column("team").to_pylist(), b.column("gap").to_pylist())):
                points = b.column("points")[i].values
                ids, v, kind = _ids(points.field("_id")), _matrix(points.field("_v")), points.field("_id").type
                tag = points.field("_t").to_numpy()
                if key != here:
                    yield from told()
                    here, team, made = key, [], np.empty(0, np.int64)
                if gap < 0:
                    team.append((Nearest(ids, v, None, eps), _distances(v, references), tag, len(made)))
                    more = {"counts": np.zeros(len(ids), np.int64), "links": len(made) + np.arange(len(ids)), "least": np.full(len(ids), 2 ** 31)}[what]
                    made = np.concatenate([made, more])
                    continue
                lo, hi = (b.column(c)[i].values.to_numpy() for c in ("lo", "hi"))
                if what == "least":
                    ids, v, tag = ids[tag >= 0], v[tag >= 0], tag[tag >= 0]
                    if not len(ids):
                        continue
                order = np.argsort(ids, kind="stable")
                placed, met = [], []  # place in the team, place in the block that is met
                for found, own, own_tag, first in team:
                    near = np.maximum(lo - own, own - hi).max(axis=1) <= eps * (1 + SLACK)
                    found.meet(ids, v, np.zeros(len(ids), np.int64), np.flatnonzero(near & (own_tag < 0) if what == "least" else near))
                    if what == "counts":
                        made[first : first + len(found.ids)] += np.bincount(found.key, minlength=len(found.ids))
                    else:
                        placed.append(found.key + first)
                        met.append(order[np.searchsorted(ids[order], found.nid)])
                    found.forget()
                if what == "counts" or not placed:
                    continue
                at, other = np.concatenate(placed), np.concatenate(met)
                if what == "least":
                    np.minimum.at(made, at, tag[other])
                elif len(at):
                    by = np.argsort(other, kind="stable")
                    at, other = at[by], other[by]
                    same = other[1:] == other[:-1]  # neighbours of one point that is met are connected
                    made = _joined(made, at[:-1][same], at[1:][same])
                    new = np.r_[True, ~same]
                    every = np.concatenate([found.ids for found, *_ in team])
                    yield rows(ids[other[new]], every[at[new]], kind)
        yield from told()
    return run


def _searched(references: np.ndarray, k: int | None, eps: float, tags: int, count: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, team, kind = None, [], None  # team: (nearest so far, distances to the references) of each block

        def told(found: Nearest) -> pa.RecordBatch:
            if count:
                return pa.RecordBatch.from_arrays([pa.array([found.compared], pa.int64())], names=["n"])
            found.settle()
            ids = pa.array(found.ids[found.key // tags], kind)
            return pa.RecordBatch.from_arrays([ids, pa.array(found.ranks(), pa.int32()), pa.array(found.nid, kind), pa.array(found.dist, pa.float64()), pa.array(found.key % tags, pa.int32())],
                                              names=["id", "rank", "nid", "dist", "tag"])
        for b in batches:
            for i, (key, near) in enumerate(zip(b.column("team").to_pylist(), b.column("gap").to_pylist())):
                points = b.column("points")[i].values
                ids, v, kind = _ids(points.field("_id")), _matrix(points.field("_v")), points.field("_id").type
                if key != here:
                    yield from (told(found) for found, _ in team)
                    here, team = key, []
                if near < 0:
                    team.append((Nearest(ids, v, k, eps, tags), _distances(v, references)))
                    continue
                lo, hi = (b.column(c)[i].values.to_numpy() for c in ("lo", "hi"))
                for found, own in team:
                    gap = np.maximum(lo - own, own - hi).max(axis=1)
                    found.meet(ids, v, points.field("_t").to_numpy(), np.flatnonzero(gap <= found.limit.max(axis=1) * (1 + SLACK)))
                    if k is None and len(found.key) and not count:  # every pair counts: hand them on
                        yield told(found)
                        found.forget()
        yield from (told(found) for found, _ in team)
    return run


def radius_pairs(df: DataFrame, id_col: str, vec_col: str, eps: float) -> DataFrame:
    """All ordered pairs (id, nid, dist) with dist <= eps, self excluded."""
    return Blocks(df, id_col, vec_col, None, float(eps)).search().select("id", "nid", "dist")


def knn(df: DataFrame, id_col: str, vec_col: str, k: int = 5) -> DataFrame:
    """Exact k nearest neighbours (self excluded, ties by neighbour id): (id, rank, nid, dist)."""
    return Blocks(df, id_col, vec_col, k).search().drop("tag")


def knn_by_tag(df: DataFrame, id_col: str, vec_col: str, tag_col: str, tags: int, k: int = 5) -> DataFrame:
    """The k nearest neighbours of each tag 0 .. tags - 1 (folds, say) in one search: (id, rank, nid, dist, tag)."""
    return Blocks(df, id_col, vec_col, k, tag_col=tag_col, tags=tags).search()


def knn_probed(df: DataFrame, id_col: str, vec_col: str, k: int = 5, probes: int = PROBES) -> DataFrame:
    """Approximate k nearest neighbours: each point is compared with the points of the ``probes`` cells
    nearest to its own (measure the recall with ``recall``)."""
    return Blocks(df, id_col, vec_col, k).search(probes).drop("tag")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    both = exact.join(found.select("id", "nid"), ["id", "nid"], "left_semi").count()
    return both / max(1, exact.count())
