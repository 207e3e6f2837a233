"""Nearest vectors by exact cosine: probes and vectors are dealt into tiles, each pair of tiles is one task's product of matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkgrain.functions import scoring as sc

#: Probes and vectors of a tile, about.
PROBES, VECTORS = 4096, 16384
#: Cells of a product that is held at once.
CELLS = 4_000_000


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, d: int) -> np.ndarray:
    taken = column.take(pa.array(rows)).combine_chunks()
    return taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)


def _chosen(p: pa.Table, v: pa.Table, n: int, slack: float, clamp: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of p and of v, and similarities: of each probe all that can be among its n best of this tile; of more than n equal ones the n smallest by `_rank`."""
    sizes = [pc.list_value_length(t["vector"]).to_numpy() for t in (p, v)]
    order = v.select(["order"]).flatten()
    rank = np.empty(v.num_rows, np.int64)
    rank[pc.sort_indices(order, sort_keys=[(c, "ascending") for c in order.column_names], null_placement="at_start").to_numpy()] = np.arange(v.num_rows)
    own = None
    if "own" in p.column_names:
        both = pa.chunked_array([*p["own"].chunks, *v["own"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        own = both[: p.num_rows], both[p.num_rows :]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for d in np.intersect1d(*sizes):
        rp, rv = (np.flatnonzero(s == d) for s in sizes)
        b, nb = _matrix(v["vector"], rv, d), v["norm"].to_numpy()[rv]
        step = max(1, CELLS // len(rv))
        for at in range(0, len(rp), step):
            rows = rp[at : at + step]
            a, na = _matrix(p["vector"], rows, d), p["norm"].to_numpy()[rows]
            with np.errstate(all="ignore"):
                near = (a @ b.T) / (na[:, None] * nb[None, :])
                near = np.nan_to_num(near, nan=2.0, posinf=2.0, neginf=-2.0)
            if clamp:
                near = np.clip(near, 0.0, 1.0)
            if own is not None:
                near[own[0][rows][:, None] == own[1][rv][None, :]] = -np.inf
            least = np.partition(near, len(rv) - n, axis=1)[:, len(rv) - n] if len(rv) > n else np.full(len(rows), -3.0)
            i, j = np.nonzero(near >= np.maximum(least, -3.0)[:, None] - slack)
            with np.errstate(all="ignore"):
                s = np.zeros(len(i))
                for k in range(d):  # in the order of the dimensions, as the column expression adds
                    s += b[j, k] * a[i, k]
                s = s / (nb[j] * na[i])
            if clamp:
                s = np.where(np.isnan(s), 1.0, np.clip(s, 0.0, 1.0))
            o = np.lexsort((rank[rv[j]], -s, i))
            i, j, s = i[o], j[o], s[o]
            new = np.r_[True, (i[1:] != i[:-1]) | (s[1:] != s[:-1])] if len(i) else np.zeros(0, bool)
            nth = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
            out.append((rows[i[nth < n]], rv[j[nth < n]], s[nth < n]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def candidates(probes: DataFrame, vectors: DataFrame, n: int, slack: float = 1e-12, clamp: bool = False) -> DataFrame:
    """query, unit, similarity: each probe's n nearest vectors of its key are among the rows, which few others join.

    probes: key, query, vector and perhaps own; vectors: key, unit, order (query, unit and order are structs), vector, own. Pairs of one `own`, a text, are none. Only vectors of
    equal length and of a norm above zero count. Tiles are counted for each key, so a key of very many vectors is dealt to many tasks. Similarities are sums in
    the order of dimensions, as functions.scoring adds them; the product of matrices only tells which pairs, with `slack`, are worth it.
    """
    norm = F.sqrt(sc.dot(F.col("vector"), F.col("vector")))
    p, v = (t.withColumn("norm", norm).filter("norm > 0") for t in (probes, vectors))
    tiles = lambda t, size, name: t.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = tiles(p, PROBES, "_np").join(tiles(v, VECTORS, "_nv"), "key")

    def dealt(t: DataFrame, of: str, mine: str, others: str, by: Column) -> DataFrame:
        rows = t.join(grid, "key").withColumn(mine, F.pmod(F.xxhash64(by), F.col(f"_n{of}")).cast("int"))
        return rows.withColumn(others, F.explode(F.sequence(F.lit(0), F.col("_nv" if of == "p" else "_np") - 1))).drop("_np", "_nv")

    kinds = {f.name: f.dataType for f in (*probes.schema.fields, *vectors.schema.fields)}

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, s = _chosen(left, right, n, slack, clamp)
        return pa.table({"query": left["query"].take(pa.array(i)), "unit": right["unit"].take(pa.array(j)), "similarity": s})

    a = dealt(p, "p", "pt", "vt", F.col("query")).groupBy("key", "pt", "vt")
    b = dealt(v, "v", "vt", "pt", F.col("unit")).groupBy("key", "pt", "vt")
    return a.cogroup(b).applyInArrow(tile, StructType().add("query", kinds["query"]).add("unit", kinds["unit"]).add("similarity", "double"))
