"""A positional inverted index kept as a table, with upkeep by increments, and search in it by words, phrases and exclusions.

The table is a log of generations. One holds the postings (unit, term, positions) of the units that came with it, dealt into folders by hash of the term, and a list
of these units and of those deleted. A row has the postings of a term in some units that one task read together, a block: texts are inverted where they are read, none of
their words is shuffled, and all postings of a unit have the same block. A posting counts if its generation is the last that names its unit, so adding, changing and deleting units never
rewrites what is there; compact() does. Writing a generation again replaces it, as a streaming sink must when a batch is retried.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.functions.text import TERM
from talkgrain.session import delete, exists, rename

#: Folders that terms are dealt to.
PARTS = 32
#: Rank of a cover that holds nothing but the words asked for.
UNIT_RANK = 0.1
#: Words that are inverted at a time; a longer text is alone.
WORDS = 1 << 20
#: Units of a block after compact(), about.
UNITS = 4096
_ROWS = "block bigint, term string, units array<{kind}>, tfs array<int>, positions array<array<int>>"
#: More than any place in a text.
_FAR = 1 << 32


def words(text: Column) -> Column:
    """The lower-case terms of a text in order; their places count from 0."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _inverted(batches):
    """unit, words to block, term, units, tfs, positions, for a bounded number of words at a time."""
    block = (task.partitionId() if (task := TaskContext.get()) else 0) << 32
    for b in batches:
        words, ends = b.column("words"), b.column("words").offsets.to_numpy()
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS, "right")) - 1)
            first, n = ends[lo:hi], np.diff(ends[lo : hi + 1])
            coded = words.values.slice(ends[lo], ends[hi] - ends[lo]).dictionary_encode()
            unit, at = np.repeat(np.arange(hi - lo), n), np.arange(ends[lo], ends[hi]) - np.repeat(first, n)
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(code * (hi - lo) + unit, kind="stable")  # so that places stay in order
            code, unit, at = code[order], unit[order], at[order].astype(np.int32)
            post = _starts(code, unit)
            terms = _starts(code[post])
            cols = coded.dictionary.take(pa.array(code[post][terms])), b.column("unit").slice(lo, hi - lo).take(pa.array(unit[post])), pa.array(np.diff(np.append(post, len(at))).astype(np.int32))
            same = pa.array(np.full(len(terms), block))
            yield pa.RecordBatch.from_arrays([same, cols[0], *(_lists(terms, c) for c in (*cols[1:], _lists(post, pa.array(at))))], names=["block", "term", "units", "tfs", "positions"])
            lo, block = hi, block + 1


def _packed(batches):
    """Sorted postings (block, term, unit, tf, positions) to rows of a block, term, units, tfs, positions."""
    for b in batches:
        rows = _starts(*(b.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("block", "term")))
        cols = [*(b.column(c).take(pa.array(rows)) for c in ("block", "term")), *(_lists(rows, b.column(c)) for c in ("unit", "tf", "positions"))]
        yield pa.RecordBatch.from_arrays(cols, names=["block", "term", "units", "tfs", "positions"])


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


class TextIndex:
    """The index in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def write(self, units: DataFrame, gen: int, unit_id: str, text: Column, deleted: Column | None = None) -> None:
        """Adds a generation: units that are new, changed or, by `deleted`, gone. Later generations have greater numbers.

        Within one each unit should come once; of more rows the texts are joined in one unit. Null ids are left out; a null text is a unit without terms.
        """
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        rows = units.filter(F.col(unit_id).isNotNull()).select(F.col(unit_id).cast(self.kind).alias("unit"), gone.alias("gone"), words(text).alias("words"))
        there, kind = rows.filter("not gone").select("unit", "words"), _ROWS.format(kind=self.kind)
        twice = there.groupBy("unit").count().filter("count > 1").select("unit")
        if twice.isEmpty():
            found = there.mapInArrow(_inverted, kind)
        else:
            more = there.join(twice, "unit", "left_semi").select("unit", F.posexplode("words").alias("position", "term"))
            more = more.groupBy("unit", "term").agg(F.array_sort(F.collect_list("position")).alias("positions"))
            more = more.select(F.xxhash64("unit").alias("block"), "term", F.array("unit").alias("units"), F.array(F.size("positions")).alias("tfs"), F.array("positions").alias("positions"))
            found = there.join(twice, "unit", "left_anti").mapInArrow(_inverted, kind).unionByName(more)
        found.withColumn("part", _part(F.col("term"))).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings/gen={gen}")
        rows.groupBy("unit").agg(F.min("gone").alias("gone")).write.mode("overwrite").parquet(f"{self.path}/units/gen={gen}")

    def sink(self, unit_id: str, text: Column, deleted: Column | None = None):
        """For foreachBatch: each micro-batch is a generation, numbered from 1 by its batch; a batch that is run again replaces its own."""
        return lambda batch, batch_id: self.write(batch, batch_id + 1, unit_id, text, deleted)

    def live(self) -> DataFrame:
        """unit, gen: the units that are there, with the generation that counts."""
        if not exists(self.spark, f"{self.path}/units"):
            return self.spark.createDataFrame([], f"unit {self.kind}, gen bigint")
        log = self.spark.read.schema(f"unit {self.kind}, gone boolean, gen bigint").parquet(f"{self.path}/units")
        last = log.groupBy("unit").agg(F.max_by("gone", "gen").alias("gone"), F.max("gen").alias("gen"))
        return last.filter("not gone").select("unit", "gen")

    def postings(self, terms: DataFrame | None = None, places: bool = True) -> DataFrame:
        """unit, term, tf and, unless told not to, positions: those of live units; of the terms(term) only, if given, from the folders that can hold them."""
        each = ["units", "tfs", "positions"][: 2 + places]
        p = self._rows(terms).select("term", "gen", F.inline(F.arrays_zip(*each)).alias("unit", "tf", *each[2:])).withColumn("tf", F.col("tf").cast("bigint"))
        return (p if self._all_live() else p.join(self.live(), ["unit", "gen"], "left_semi")).select("unit", "term", "tf", *each[2:])

    def blocks(self, terms: DataFrame) -> DataFrame:
        """block, term, units, tfs: as postings() without places; units of a term in a block may be in several rows."""
        p = self._rows(terms)
        if not self._all_live():
            p = p.select("block", "term", "gen", F.inline(F.arrays_zip("units", "tfs")).alias("unit", "tf")).join(self.live(), ["unit", "gen"], "left_semi")
            p = p.withColumns({"units": F.array("unit"), "tfs": F.array("tf")})
        return p.select("block", "term", "units", "tfs")

    def _rows(self, terms: DataFrame | None) -> DataFrame:
        kind = _ROWS.format(kind=self.kind) + ", part int, gen bigint"
        if not exists(self.spark, f"{self.path}/postings"):
            return self.spark.createDataFrame([], kind)
        p = self.spark.read.schema(kind).parquet(f"{self.path}/postings")
        if terms is None:
            return p
        parts = [r[0] for r in terms.select(_part(F.col("term"))).distinct().collect()]  # at most PARTS numbers
        return p.filter(F.col("part").isin(parts)).join(terms.select("term").distinct(), "term", "left_semi")

    def _all_live(self) -> bool:
        return not exists(self.spark, f"{self.path}/units") or (len(self.generations()) == 1 and not self._deletes())

    def generations(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/units")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()[4:]) for f in fs.listStatus(folder) if f.getPath().getName().startswith("gen="))

    def _deletes(self) -> bool:
        return not self.spark.read.schema(f"unit {self.kind}, gone boolean, gen bigint").parquet(f"{self.path}/units").filter("gone").isEmpty()

    def compact(self) -> None:
        """All live postings as one generation, the last one's number. Readers of the old files must have ended."""
        gens = self.generations()
        if not gens:
            return
        new = f"{self.path}.{uuid.uuid4().hex}"
        n = max(1, -(-self.live().count() // UNITS))
        p = self.postings().withColumn("tf", F.col("tf").cast("int")).withColumns({"part": _part(F.col("term")), "block": F.pmod(F.xxhash64("unit"), F.lit(n))})
        p = p.repartition("part", F.pmod("block", F.lit(4))).sortWithinPartitions("part", "block", "term").drop("part")
        p.mapInArrow(_packed, _ROWS.format(kind=self.kind)).withColumn("part", _part(F.col("term"))).write.partitionBy("part").parquet(f"{new}/postings/gen={gens[-1]}")
        self.live().select("unit", F.lit(False).alias("gone")).write.parquet(f"{new}/units/gen={gens[-1]}")
        delete(self.spark, self.path)
        rename(self.spark, new, self.path)


def parsed(queries: DataFrame, query_id: str, query: Column) -> DataFrame:
    """query_id, alternative, item, terms, excluded: what a web-style query asks for.

    Words, "quoted phrases", exclusions by a leading hyphen, and `or` between alternatives, each of which needs all of its items. Words joined by a hyphen are
    one term here as in the index. An alternative without a positive item asks for nothing.
    """
    token = r'-?"[^"]*"|[^\s"]+'
    q = queries.select(query_id, F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(token), F.lit(0))).alias("item", "token"))
    either = F.col("token") == "or"
    q = q.withColumn("alternative", F.sum(either.cast("int")).over(W.partitionBy(query_id).orderBy("item"))).filter(~either)
    q = q.withColumn("excluded", F.col("token").startswith("-")).withColumn("terms", F.regexp_extract_all(F.regexp_replace("token", "^-", ""), F.lit(TERM), F.lit(0)))
    q = q.filter(F.size("terms") > 0).select(query_id, "alternative", "item", "terms", "excluded")
    asked = q.filter("not excluded").select(query_id, "alternative").distinct()
    return q.join(asked, [query_id, "alternative"], "left_semi")


def _latest(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The greatest value so far, within each of the groups in order; values are from 0 to _FAR."""
    return np.maximum.accumulate(group * _FAR + value) - group * _FAR


def _before(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The greatest value of the rows before, within each of the groups in order; 0 for a first one."""
    out = np.zeros(len(value), np.int64)
    out[1:] = np.where(group[1:] == group[:-1], _latest(group, value)[:-1], 0)
    return out


def _covered(b: pa.RecordBatch, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups with covers, their ranks and numbers of covers. Rows: the hits of whole groups, numbered in order."""
    col = {c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("alternative", "item", "slot", "need", "n", "k", "excluded")}
    _, alt = np.unique(np.stack([group, col["alternative"]]), axis=1, return_inverse=True)
    kinds, row, item = np.unique(alt.ravel() * _FAR + col["item"], return_index=True, return_inverse=True)
    alt, slot, need, n, excluded = alt.ravel()[row], col["slot"][row], col["need"][row], col["n"][row], col["excluded"][row] > 0
    of_alt = group[row]
    # Places where an item's terms stand side by side: those at which each of its terms speaks for the same start.
    places = b.column("positions")
    size = pc.list_value_length(places).to_numpy(zero_copy_only=False)
    hit, at = np.repeat(np.arange(b.num_rows), size), places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    once = _starts(hit, at)
    hit, first = hit[once], at[once] - col["k"][hit[once]]
    hit, first = hit[first >= 0], first[first >= 0]
    start, said = np.unique(item.ravel()[hit] * _FAR + first, return_counts=True)
    it, first = start // _FAR, start % _FAR
    whole = said == n[it]
    it, first = it[whole], first[whole]
    barred = np.zeros(alt.max() + 1, bool)
    barred[alt[it[excluded[it]]]] = True
    good = ~excluded[it] & ~barred[alt[it]]
    it, first = it[good], first[good]
    has = np.bincount(alt[np.unique(it)], minlength=len(barred))
    full = has[alt[it]] == need[it]
    # Of each full alternative the shortest stretches that hold all items, in one sweep over places by their ends: it keeps each item's latest start. Where all
    # have one, the least of them is where a stretch that ends here must begin; it is a shortest one if that start is later than that of any stretch before.
    p, f = it[full], first[full]
    last = f + n[p] - 1
    order = np.lexsort((slot[p], f, last, alt[p]))
    p, f, last = p[order], f[order], last[order]
    a, low = alt[p], np.full(len(p), _FAR - 1)
    for j in range(int(need[p].max(initial=0))):
        low = np.where(j < need[p], np.minimum(low, _latest(a, np.where(slot[p] == j, f + 1, 0))), low)
    is_cover = low > _before(a, low)
    g, f, last = of_alt[p[is_cover]], low[is_cover] - 1, last[is_cover]
    order = np.lexsort((-f, last, g))
    g, f, last = g[order], f[order], last[order]
    least = f + 1 > _before(g, f + 1)  # none within it, of another alternative either; of equal ones the first
    g, f, last = g[least], f[least], last[least]
    here = np.isin(of_alt[it], g)
    span = n[it[here]]
    word = np.repeat(first[here], span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
    asked = np.unique(np.repeat(of_alt[it[here]], span) * _FAR + word)
    noise = last - f + 1 - (np.searchsorted(asked, g * _FAR + last, "right") - np.searchsorted(asked, g * _FAR + f, "left"))
    found = _starts(g) if len(g) else np.zeros(0, np.int64)
    total = np.add.reduceat(UNIT_RANK / (1 + noise), found) if len(g) else np.zeros(0)
    return g[found], total, np.diff(np.append(found, len(g)))


def cover_density(items: DataFrame, postings: DataFrame, query_id: str) -> DataFrame:
    """query_id, unit, rank, covers: units that a query matches, by the density of what it asks for.

    A cover is a shortest stretch of a unit that satisfies the query; it counts 0.1 / (1 + the words in it that the query doesn't ask for). Of one word
    each occurrence is a cover, of several alternatives a stretch counts if none within it satisfies any. A unit with an excluded item in every
    alternative that it satisfies isn't matched.

    A query's postings in a unit meet, sorted, in one shuffle, each with its array of places; batches of them are swept as arrays.
    """
    kind, here = dict(items.dtypes) | dict(postings.dtypes), [query_id, "unit"]
    alternative = W.partitionBy(query_id, "alternative")
    each = items.withColumn("need", F.count_if(~F.col("excluded")).over(alternative)).withColumn("slot", F.row_number().over(W.partitionBy(query_id, "alternative", "excluded").orderBy("item")) - 1)
    each = each.select(query_id, "alternative", "item", "slot", "need", "excluded", F.size("terms").alias("n"), F.posexplode("terms").alias("k", "term"))
    hits = each.join(postings.select("unit", "term", "positions"), "term").drop("term").repartition(*here).sortWithinPartitions(*here)

    def run(batches):
        left = None  # a batch's last group goes on in the next
        for b in batches:
            b = b if left is None else pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0]
            starts = _starts(*(b.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in here)) if b.num_rows else [0]
            left = b.slice(starts[-1])
            yield from ranks(b.slice(0, starts[-1]))
        if left is not None:
            yield from ranks(left)

    def ranks(b):
        if not b.num_rows:
            return
        starts = _starts(*(b.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in here))
        found, rank, covers = _covered(b, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, b.num_rows))))
        at = pa.array(starts[found])
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in here), pa.array(rank), pa.array(covers.astype(np.int64))], names=[*here, "rank", "covers"])

    return hits.mapInArrow(run, f"`{query_id}` {kind[query_id]}, unit {kind['unit']}, rank double, covers bigint")


def search(index: TextIndex, queries: DataFrame, query_id: str, query: Column, n: int = 30) -> DataFrame:
    """query_id, unit, rank, covers, pos: the n best units of each web-style query, by cover density and then by id."""
    items = parsed(queries, query_id, query)
    ranked = cover_density(items, index.postings(items.select(F.explode("terms").alias("term"))), query_id)
    order = W.partitionBy(query_id).orderBy(F.round("rank", 9).desc(), "unit")
    return ranked.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)
