"""Embedding near-dedup by PCA-ordered tiled comparison, exact in double precision.

Equal vectors are collapsed first. The principal axes come from the second moments of the unit vectors (a d x d table).
Quantile cells along the leading axes, cut into tiles of a bounded number of vectors, keep near vectors together; two
tiles are compared only if the boxes around their rotated vectors come as near as the cosine asks for. A pair of tiles is one
task: it accumulates the products of the leading dimensions, bounds what is missing by the norms of the remaining
ones, and follows only pairs that can still reach the threshold. A task gives link counts and a forest of links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch, components

#: Vectors of a tile. A vector is read once for each tile that its own meets; two tiles of 64 doubles a vector are 8 MB.
TILE = 8192
#: So many tiles at least, where there are vectors enough, so that their pairs are tasks for all cores.
TILES = 6
AXES = 4
SLACK = 1e-9


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which rounds nothing, with components between -1 and 1: squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def usable(v: Column) -> Column:
    """Not null, not zero, and all components finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)


def _axes(reps: DataFrame, dim: int) -> np.ndarray:
    """Principal axes as columns, by falling variance; the driver gets d * d sums."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            u = _unit(_matrix(b.column("v")))
            total += u.T @ u
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "x"])

    got = reps.select("v").mapInArrow(moments, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    m = np.zeros((dim, dim))
    m[got["i"], got["j"]] = got["x"]
    value, vector = np.linalg.eigh((m + m.T) / 2)
    return vector[:, np.argsort(-value)]


def _placed(reps: DataFrame, axes: np.ndarray, scratch: Scratch, tile: int) -> tuple[DataFrame, DataFrame]:
    """reps with their tile, and the tiles' boxes."""
    lead = min(AXES, axes.shape[0])

    def rotate(batches):
        for b in batches:
            y = _unit(_matrix(b.column("v"))) @ axes[:, :lead]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), b.column("v"), pa.array(list(y), pa.list_(pa.float64()))], names=["rep", "n", "v", "y"])

    n = reps.count()
    tile = min(tile, max(1024, -(-n // TILES)))
    rot = reps.select("rep", "n", "v").mapInArrow(rotate, f"rep long, n long, v {dict(reps.dtypes)['v']}, y array<double>")
    # Cells: the same number of quantile bins along each leading axis, some tiles a cell at most.
    bins = max(1, round((n / tile) ** (1 / lead)))
    cell = F.lit(0)
    if bins > 1:
        cuts = rot.agg(*[F.percentile_approx(F.col("y")[a], [i / bins for i in range(1, bins)], 10_000).alias(f"c{a}") for a in range(lead)]).first()
        for a in range(lead):
            at = sum((F.when(F.col("y")[a] > c, 1).otherwise(0) for c in cuts[f"c{a}"]), F.lit(0))
            cell = cell * bins + at
    rot = scratch.write(rot.withColumn("cell", cell), "rotated")
    # A full cell is cut into chunks, by hash; bounded counts, one row a cell.
    sizes = scratch.write(rot.groupBy("cell").agg(F.count("*").alias("c")).withColumn("chunks", F.ceil(F.col("c") / tile).cast("int")).select("cell", "chunks"), "cells")
    placed = rot.join(sizes, "cell").withColumn("tile", F.concat_ws("-", "cell", F.pmod(F.xxhash64("rep"), F.col("chunks"))))
    placed = scratch.write(placed.drop("chunks", "cell"), "placed")
    box = [f(F.col("y")[a]).alias(f"{k}{a}") for a in range(lead) for k, f in (("lo", F.min), ("hi", F.max))]
    return placed, scratch.write(placed.groupBy("tile").agg(*box), "boxes")


def _tile_pairs(boxes: DataFrame, lead: int, radius: float) -> DataFrame:
    """(p, q) with p <= q whose boxes are within the radius. Joined on slabs of that width along the first axis."""
    slab = lambda x: F.floor(x / radius)
    spread = boxes.withColumn("slab", F.explode(F.sequence(slab(F.col("lo0") - radius), slab(F.col("hi0") + radius))))
    own = boxes.withColumn("slab", F.explode(F.sequence(slab(F.col("lo0")), slab(F.col("hi0")))))
    a, b = spread.alias("a"), own.alias("b")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")), 2) for k in range(lead)), F.lit(0.0))
    near = a.join(b, (F.col("a.slab") == F.col("b.slab")) & (gap <= radius * radius))
    return near.select(F.least("a.tile", "b.tile").alias("p"), F.greatest("a.tile", "b.tile").alias("q")).distinct()


def compared(x: np.ndarray, y: np.ndarray, axes: np.ndarray, least: float):
    """Index pairs of rows of x and y whose cosine is at least `least`, in portions of at most 200,000 pairs, so that none but these are held."""
    ux, uy = _unit(x), _unit(y)
    rx, ry = ux @ axes, uy @ axes
    dim, step = x.shape[1], 512
    tail = lambda r: np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]))
    tx, ty = (np.concatenate([tail(r), np.zeros((len(r), 1))], axis=1) for r in (rx, ry))
    for lo in range(0, len(x), step):
        at, done = slice(lo, lo + step), 0
        acc = np.zeros((len(rx[at]), len(ry)))
        i = j = None
        for until in (*(d for d in (8, 16, 32) if d < dim), dim):
            if i is None:
                acc += rx[at, done:until] @ ry[:, done:until].T
                may = acc + np.outer(tx[at, until], ty[:, until]) >= least - SLACK
                if np.count_nonzero(may) < may.size / 20:  # few enough to follow one by one
                    i, j = np.nonzero(may)
                    part = acc[i, j]
            elif len(i):
                part = part + (rx[at][i, done:until] * ry[j, done:until]).sum(axis=1)
                go = part + tx[at][i, until] * ty[j, until] >= least - SLACK
                i, j, part = i[go], j[go], part[go]
            done = until
        if i is None:
            i, j = np.nonzero(may)
        # What is left is decided on the vectors themselves, scaled so that no square overflows.
        for a in range(0, len(i), 200_000):
            p, q = i[a : a + 200_000], j[a : a + 200_000]
            vx, vy = _scaled(x[at][p]), _scaled(y[q])
            cos = (vx * vy).sum(axis=1) / (np.sqrt((vx * vx).sum(axis=1)) * np.sqrt((vy * vy).sum(axis=1)))
            ok = cos >= least
            yield p[ok] + lo, q[ok]


def compare(x: np.ndarray, y: np.ndarray, axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs at once."""
    parts = [*compared(x, y, axes, least)]
    z = np.zeros(0, np.int64)
    return tuple(np.concatenate([z, *(p[k] for p in parts)]) for k in (0, 1))


def forest(i: np.ndarray, j: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the smallest node that links (i, j) reach from it; label: what earlier links reach."""
    label = np.arange(n) if label is None else label
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = new[label]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        go = label[i] != label[j]
        i, j = i[go], j[go]
    return label


def links(vectors: DataFrame, scratch: Scratch, least: float = 0.95, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector.

    vectors: vec_id, embedding; other columns are ignored. Vectors that are null, empty or zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths with each other. Rows that repeat a
    vec_id are vectors of their own and link if they reach the threshold. Rows without vec_id are dropped. least must be above 0.
    """
    v = scratch.write(vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(F.col("embedding")), F.col("embedding")).alias("v")), "vectors")
    # Distinct vectors are numbered, as two of them may have the same vec_id.
    reps = v.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    reps = scratch.write(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    found = None
    for (dim,) in reps.select(F.size("v").alias("d")).distinct().collect():  # lengths of vectors, one as a rule
        one = _links_of(reps.filter(F.size("v") == dim), dim, scratch, least, tile)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.write(found, "links")
    count = found.groupBy("rep").agg(F.sum("add").alias("add"))
    edges = found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    comp = components(edges, scratch).withColumnRenamed("node", "rep")
    small = scratch.write(comp.join(reps.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("smallest")), "smallest")
    rep = reps.join(count, "rep", "left").join(comp, "rep", "left").join(small, "component", "left")
    rep = scratch.write(rep.select("v", F.col("n").alias("copies"), F.coalesce("add", F.lit(0)).alias("add"), F.coalesce("smallest", "low").alias("component_id")), "result")
    out = v.join(rep.withColumnRenamed("v", "w"), F.col("v") == F.col("w"), "left")
    out = out.select("vec_id", F.coalesce(F.col("add") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links_of(reps: DataFrame, dim: int, scratch: Scratch, least: float, tile: int) -> DataFrame:
    axes = _axes(reps, dim)
    placed, boxes = _placed(reps, axes, scratch, tile)
    radius = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    pairs = scratch.write(_tile_pairs(boxes, min(AXES, dim), radius), "tile-pairs")
    sides = pairs.select("p", "q", F.explode(F.when(F.col("p") == F.col("q"), F.array("p")).otherwise(F.array("p", "q"))).alias("tile"))
    rows = placed.select("rep", "n", "v", "tile").join(sides, "tile")

    def task(t: pa.Table) -> pa.Table:
        mine = np.array(t.column("tile").to_pylist()) == t.column("p")[0].as_py()
        same = t.column("p")[0] == t.column("q")[0]
        rep, n, v = t.column("rep").to_numpy(), t.column("n").to_numpy(), _matrix(t.column("v"))
        order = np.argsort(rep, kind="stable")  # so that the forest's roots are smallest
        rep, n, v, mine = rep[order], n[order], v[order], mine[order]
        a, b = np.flatnonzero(mine), np.flatnonzero(mine if same else ~mine)
        add, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, j in compared(v[a], v[b], axes, least):
            i, j = a[i], b[j]
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(add, i, n[j])
            np.add.at(add, j, n[i])
            label = forest(i, j, len(rep), label)
        hit = add > 0
        return pa.table({"rep": rep[hit], "add": add[hit], "root": rep[label[hit]]})

    return rows.groupBy("p", "q").applyInArrow(task, "rep long, add long, root long")
