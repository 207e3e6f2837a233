"""Units by how often they hold a query's terms: queries and blocks of postings are dealt into tiles, each pair of tiles is one task's sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Terms of queries and postings of a tile, about.
ASKED, POSTINGS = 1 << 18, 1 << 20
#: Sums that are held at once.
CELLS = 4_000_000


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values in ascending order, null first, and the values."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return number[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _sums(asked: pa.Table, found: pa.Table, n: int | None) -> pa.Table:
    """query, unit, matched: of each query the n units of this tile with the most matches, of equal ones the smallest; all for n null."""
    term, _ = _codes(pa.chunked_array([*asked["term"].chunks, *found["term"].chunks], pa.string()))
    query, queries = _codes(asked["query"])
    wanted = np.isin(term[asked.num_rows :], term[: asked.num_rows])
    word, found = term[asked.num_rows :][wanted], found.filter(pa.array(wanted))
    unit, units = _codes(pc.list_flatten(found["units"]))
    word = np.repeat(word, pc.list_value_length(found["units"]).to_numpy())
    tf = pc.list_flatten(found["tfs"]).to_numpy().astype(np.int64)
    order = np.lexsort((unit, word))
    word, unit, tf = word[order], unit[order], tf[order]
    new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (unit[1:] != unit[:-1])]) if len(word) else np.zeros(0, np.int64)
    word, unit, tf = word[new], unit[new], np.add.reduceat(tf, new) if len(new) else tf
    order = np.argsort(query, kind="stable")
    query, term = query[order], term[: asked.num_rows][order]
    lo, hi = np.searchsorted(word, term, "left"), np.searchsorted(word, term, "right")
    out, m = [(np.zeros(0, np.int64),) * 3], len(units)
    step = max(1, CELLS // max(1, m))
    for first in range(0, len(queries) if m else 0, step):
        total = np.zeros((min(step, len(queries) - first), m), np.int64)
        for k in range(*np.searchsorted(query, [first, first + step])):
            total[query[k] - first, unit[lo[k] : hi[k]]] += tf[lo[k] : hi[k]]  # a unit is there once a term
        if n is None or m <= n:
            i, j = np.nonzero(total)
        else:
            best = np.argpartition(total * m + np.arange(m)[::-1], m - n, axis=1)[:, m - n :]
            i, at = np.nonzero(np.take_along_axis(total, best, axis=1))
            j = best[i, at]
        out.append((first + i, j, total[i, j]))
    i, j, s = map(np.concatenate, zip(*out, strict=True))
    return pa.table({"query": queries.take(pa.array(i)), "unit": units.take(pa.array(j)), "matched": s})


def matches(asked: DataFrame, blocks: DataFrame, n: int | None = None) -> DataFrame:
    """query, unit, matched: units with occurrences of a query's terms; of each query its n first by matches and then by unit are among the rows, which few others join.

    asked: query, term; blocks: block, term, units, tfs. All postings of a unit have one block, so a unit's sum is made in one task and its parts aren't shuffled: postings
    move once for many queries, and each tile passes on no more than n rows a query.
    """
    grid = asked.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / ASKED)).cast("int").alias("_nq"))
    grid = grid.crossJoin(blocks.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("units")) / POSTINGS)).cast("int").alias("_nb")))

    def dealt(t: DataFrame, by: str, mine: str, others: str) -> DataFrame:
        of = {"qt": "_nq", "bt": "_nb"}
        rows = t.crossJoin(F.broadcast(grid)).withColumn(mine, F.pmod(F.xxhash64(by), F.col(of[mine])).cast("int"))
        return rows.withColumn(others, F.explode(F.sequence(F.lit(0), F.col(of[others]) - 1))).drop("_nq", "_nb", "block").groupBy("qt", "bt")

    kinds = {f.name: f.dataType for f in (*asked.schema.fields, *blocks.schema.fields)}

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        return _sums(left, right, n)

    out = StructType().add("query", kinds["query"]).add("unit", kinds["units"].elementType).add("matched", "long")
    return dealt(asked, "query", "qt", "bt").cogroup(dealt(blocks, "block", "bt", "qt")).applyInArrow(tile, out)
