"""The nearest vectors of many queries, exactly, with queries and index both dealt out."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lettermill.functions.vectors import half_up
from lettermill.session import durable, ship

DIGITS = 4
#: Cells are about as many as the root of the rows, and no more than this.
MOST_PIVOTS = 4096
CHUNK = 4096
#: An index up to this size goes to the tasks that hold the queries.
SMALL_BYTES = 16 << 20
#: Vectors of so many lengths, at most, may stand in one index.
LENGTHS = 64
SLACK = 1e-9
#: Rows of a batch that a task hands on.
TOLD = 4096


def matrix(column: pa.Array, size: int, which: np.ndarray) -> np.ndarray:
    """The rows ``which`` of a list column, all of ``size`` numbers."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.asarray(column.offsets)[:-1][which]
    return flat[begin[:, None] + np.arange(size)]


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(np.asarray(column.offsets))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def best_of(query: np.ndarray, score: np.ndarray, place: np.ndarray, limit: int) -> np.ndarray:
    """Positions of each query's ``limit`` best, by score, then by place."""
    order = np.lexsort((place, -score, query))
    sorted_ = query[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < limit]


def ranks(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.rank(column, sort_keys="ascending", tiebreaker="dense"))


def compare(queries: pa.Table, rows: pa.Table, vector: str, ordinal: str, limit: int, floor: float, any_length: bool) -> pa.Table:
    """The ``limit`` best of ``rows`` for each of ``queries`` (``query_id``,
    ``q``), with ``score``. Vectors of another length, or without one, score 0,
    as a false similarity would look like any other; they are left out unless
    ``any_length``."""
    ids, asked = queries.column("query_id").to_numpy(), queries.column("q").combine_chunks()
    have, place = rows.column(vector).combine_chunks(), ranks(rows.column(ordinal))
    n_asked, n_have = lengths(asked), lengths(have)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size in np.unique(n_asked).tolist():
        q_at, r_at = np.flatnonzero(n_asked == size), np.flatnonzero(n_have == size)
        q, r = matrix(asked, size, q_at), matrix(have, size, r_at)
        r_norm, q_norm = norms(r), norms(q)
        step = max(1, (1 << 20) // max(len(n_have), 1))  # some MB of scores at a time
        for lo in range(0, len(q_at), step):
            block = slice(lo, lo + step)
            both = q_norm[block, None] * r_norm[None, :]
            score = np.where(both > 0, q[block] @ r.T / np.where(both > 0, both, 1.0), 0.0)
            near = (score >= floor) & ((both > 0) | any_length)
            if any_length:
                whole = np.zeros((score.shape[0], len(n_have)))
                whole[:, r_at] = score
                ok = np.zeros(whole.shape, bool) if floor > 0 else np.ones(whole.shape, bool)
                ok[:, r_at] = near
                a, b = np.nonzero(ok)
                value = half_up(whole[a, b], DIGITS)
            else:
                a, b = np.nonzero(near)
                value, b = half_up(score[a, b], DIGITS), r_at[b]
            top = best_of(a, value, place[b], limit)
            kept.append((q_at[lo + a[top]], b[top], value[top]))
    q_at, r_at, value = (np.concatenate([k[j] for k in kept] or [np.zeros(0, np.int64)]) for j in range(3))
    found = rows.drop_columns([vector]).take(pa.array(r_at))
    return found.append_column("query_id", pa.array(ids[q_at])).append_column("score", pa.array(value.astype(np.float64)))


def in_order_of(schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    return lambda table: table.select(schema.names).cast(schema)


class Search:
    """The index and what is known of it; ``results`` are the rows' columns but
    the vector, ``query_id`` and ``score``."""

    def __init__(self, index: DataFrame, vector: str, ordinal: str, limit: int, floor: float, pivots: int, chunk: int = CHUNK) -> None:
        self.vector, self.ordinal, self.limit, self.floor, self.n_pivots, self.chunk = vector, ordinal, limit, floor, pivots, chunk
        self.spark, self.index = index.sparkSession, index.drop("query_id", "score", "rank")
        own = [f for f in self.index.schema.fields if f.name != vector]
        self.schema = StructType([*own, StructField("query_id", LongType()), StructField("score", DoubleType())])
        ship(self.spark)
        self.ordered = in_order_of(to_arrow_schema(self.schema))  # holds no session, as tasks need it

    def in_one(self, queries: DataFrame, rows: pa.Table) -> DataFrame:
        """All of a small index beside each part of the queries."""
        shared = self.spark.sparkContext.broadcast(rows)
        vector, ordinal, limit, floor, ordered = self.vector, self.ordinal, self.limit, self.floor, self.ordered

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and shared.value.num_rows:
                    yield from ordered(compare(pa.Table.from_batches([batch]), shared.value, vector, ordinal, limit, floor, True)).to_batches()

        return queries.mapInArrow(run, _plain(self.schema))

    # An index of any size.

    def cells(self) -> DataFrame:
        """The rows with a direction, each with its nearest pivot (``cell``), how
        far it is from it (``far``, between unit vectors) and its ``part`` of the cell."""
        length = F.aggregate(self.vector, F.lit(0.0), lambda s, x: s + x * x)
        rows = self.index.withColumns({"dims": F.size(self.vector), "part": F.pmod(F.xxhash64(self.ordinal), F.lit(1 << 30)).cast("int")}).where(length > 0)
        drawn = rows.select("dims", F.col(self.vector).alias("v")).orderBy(F.xxhash64("v"), "dims").limit(self.n_pivots).collect()  # as many vectors
        self.pivots: dict[int, np.ndarray] = {}
        for size in sorted({r["dims"] for r in drawn}):
            own = np.unique(np.array([r["v"] for r in drawn if r["dims"] == size], np.float64), axis=0)
            self.pivots[size] = own / norms(own)[:, None]
        self.first = dict(zip(self.pivots, np.cumsum([0, *map(len, self.pivots.values())]).tolist(), strict=False))
        pivots, first, vector = self.pivots, self.first, self.vector
        schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("far", DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(vector))
                sizes = lengths(column)
                cell, far = -sizes, np.zeros(len(sizes))  # a length without pivots is a cell of its own
                for size in np.unique(sizes).tolist():
                    if size in pivots:
                        at = np.flatnonzero(sizes == size)
                        x = matrix(column, size, at)
                        near = x / norms(x)[:, None] @ pivots[size].T
                        cell[at], far[at] = first[size] + near.argmax(1), np.sqrt(np.maximum(2 - 2 * near.max(1), 0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], schema.names)

        table = durable(rows.mapInArrow(run, _plain(schema)), "cells")
        facts = table.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.max("dims").alias("dims")).collect()  # a row a cell
        self.radius = {r["cell"]: (r["radius"], r["n"], r["dims"]) for r in facts}
        return table

    def visits(self, queries: DataFrame, first: bool) -> DataFrame:
        """``(query_id, q, cell)``. First: each query's nearest cells, as many as
        hold ``limit`` rows. Then, of queries with ``least`` (what a result must
        score) the others that can hold one: a cell whose vectors are at most
        its radius from its pivot has none nearer than the query's distance from
        the pivot less the radius."""
        pivots, offset, radius, limit, step = self.pivots, self.first, self.radius, self.limit, TOLD
        schema = StructType([StructField("query_id", LongType()), StructField("q", ArrayType(DoubleType())), StructField("cell", IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("q"))
                sizes, took, cells = lengths(column), [], []
                least = np.zeros(len(sizes)) if first else batch.column(batch.schema.get_field_index("least")).to_numpy(zero_copy_only=False)
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    x = matrix(column, size, at)
                    at, x = at[norms(x) > 0], x[norms(x) > 0]
                    own = np.array([c for c, (_, _, d) in sorted(radius.items()) if d == size], np.int64)
                    if not len(own) or not len(at):
                        continue
                    if size not in pivots:
                        took.append(at if first else at[:0])
                        cells.append(np.full(len(took[-1]), -size))
                        continue
                    away = np.sqrt(np.maximum(2 - 2 * (x / norms(x)[:, None] @ pivots[size][own - offset[size]].T), 0))
                    order = np.argsort(away, axis=1, kind="stable")
                    held = np.cumsum(np.array([radius[c][1] for c in own.tolist()])[order], axis=1)
                    early = np.zeros(order.shape, bool)
                    np.put_along_axis(early, order, np.c_[np.zeros(len(at), np.int64), held[:, :-1]] < limit, 1)
                    bound = away - np.array([radius[c][0] for c in own.tolist()])
                    reach = np.sqrt(np.maximum(2 - 2 * least[at], 0)) + SLACK
                    a, b = np.nonzero(early if first else ~early & (bound <= reach[:, None]))
                    took.append(at[a])
                    cells.append(own[b])
                where = np.concatenate([*took, np.zeros(0, np.int64)]).astype(np.int64)
                cell = np.concatenate([*cells, np.zeros(0, np.int64)]).astype(np.int32)
                for lo in range(0, len(where), step):  # a query that visits many cells is told of often
                    picked = batch.select(["query_id", "q"]).take(pa.array(where[lo : lo + step]))
                    yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(cell[lo : lo + step])], schema.names)

        return queries.mapInArrow(run, _plain(schema))

    def searched(self, visits: DataFrame, cells: DataFrame) -> DataFrame:
        """The best of each block of queries and rows that meet in a cell. A cell
        of many rows or many visitors is dealt into blocks of about ``chunk`` of either."""
        visits = durable(visits, "visits")
        n_asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row a cell
        facts = [(c, -(-n // self.chunk), -(-n_asked[c] // self.chunk)) for c, (_, n, _) in self.radius.items() if c in n_asked]
        if not facts:
            return self.spark.createDataFrame([], self.schema)
        blocks = F.broadcast(self.spark.createDataFrame(facts, "cell int, n_rows int, n_asked int"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asked = visits.join(blocks, "cell").withColumn("y", F.pmod(F.xxhash64("query_id"), F.col("n_asked")).cast("int"))
        asked = asked.select("cell", "y", spread("n_rows").alias("x"), "query_id", "q")
        held = cells.drop("dims", "far").join(blocks, "cell").withColumn("x", F.col("part") % F.col("n_rows"))
        held = held.select(*[c for c in self.index.columns], "cell", "x", spread("n_asked").alias("y"))
        vector, ordinal, limit, floor, ordered, own = self.vector, self.ordinal, self.limit, self.floor, self.ordered, self.index.columns

        def run(mine: pa.Table, rows: pa.Table) -> pa.Table:
            return ordered(compare(mine.select(["query_id", "q"]), rows.select(own), vector, ordinal, limit, floor, False))

        return asked.groupBy("cell", "x", "y").cogroup(held.groupBy("cell", "x", "y")).applyInArrow(run, _plain(self.schema))

    def zeros(self, queries: DataFrame) -> DataFrame:
        """What scores 0: rows without a direction or of another length, and
        all rows for queries without one. Of each length only the first ``limit``
        can be among a query's best."""
        length = F.aggregate(self.vector, F.lit(0.0), lambda s, x: s + x * x) > 0
        rows = self.index.withColumns({"dims": F.size(self.vector), "pointed": length}).drop(self.vector)
        place = F.row_number().over(Window.partitionBy("dims", "pointed").orderBy(self.ordinal))
        rows = rows.withColumn("place", place).where(F.col("place") <= self.limit).drop("place")
        few = rows.limit(2 * LENGTHS * self.limit + 1).toArrow()
        if few.num_rows > 2 * LENGTHS * self.limit:
            raise ValueError(f"the index has vectors of more than {LENGTHS} lengths")
        shared, own = self.spark.sparkContext.broadcast(few), self.schema.names[:-2]
        ordered, limit, ordinal = self.ordered, self.limit, self.ordinal

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            dims, pointed, place = rows.column("dims").to_numpy(), rows.column("pointed").to_numpy(), ranks(rows.column(ordinal))
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("q"))
                moved = np.array([any(x or 0 for x in v) for v in column.to_pylist()], bool)
                a, b = np.nonzero((lengths(column)[:, None] != dims) | ~pointed | ~moved[:, None])
                top = best_of(a, np.zeros(len(a)), place[b], limit)
                found = rows.select(own).take(pa.array(b[top]))
                ids = batch.column(batch.schema.get_field_index("query_id")).take(pa.array(a[top]))
                yield from ordered(found.append_column("query_id", ids).append_column("score", pa.array(np.zeros(len(top))))).to_batches()

        return queries.mapInArrow(run, _plain(self.schema)) if few.num_rows else self.spark.createDataFrame([], self.schema)

    def ranked(self, found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), self.ordinal))
        return found.withColumn("rank", rank).where(F.col("rank") <= self.limit)

    def in_cells(self, queries: DataFrame) -> DataFrame:
        cells = self.cells()
        if not self.radius:
            return self.zeros(queries) if self.floor <= 0 else self.spark.createDataFrame([], self.schema)
        near = durable(self.ranked(self.searched(self.visits(queries, True), cells)), "near")
        # an equal rounded score may still come before by its place
        worst = near.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
        least = F.when(F.col("n") >= self.limit, F.greatest(F.col("worst") - 0.5 * 10.0**-DIGITS - SLACK, F.lit(self.floor))).otherwise(self.floor)
        asked = queries.join(worst, "query_id", "left").select("query_id", "q", least.alias("least"))
        found = near.drop("rank").unionByName(self.searched(self.visits(asked, False), cells))
        return found.unionByName(self.zeros(queries)) if self.floor <= 0 else found


def _plain(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in schema.fields])


def nearest_rows(index: DataFrame, queries: DataFrame, limit: int, floor: float, vector: str, ordinal: str, small_bytes: int = SMALL_BYTES,
    pivots: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """For each of ``queries`` (``query_id`` long, ``q`` array<double>; distinct
    ids) its ``limit`` best rows of ``index``: their columns but the vector,
    ``query_id``, ``score`` (rounded; equal ones keep the order of ``ordinal``)
    and ``rank``.

    An index of ``small_bytes`` at most (they are counted first) is sent to each
    part of the queries. A larger one is parted into cells about ``pivots`` drawn
    vectors (the root of the rows, ``MOST_PIVOTS`` at most), and neither side
    passes through the driver.
    Each query is compared with its nearest cells; what its last result there
    scores bounds how far others can be, and only the cells that reach that far
    are visited then. The result is exact either way.
    """
    fields = index.schema.fields
    wide = [F.octet_length(f.name) if isinstance(f.dataType, StringType) else F.size(f.name) * 8 if isinstance(f.dataType, ArrayType) else F.lit(16)
        for f in fields if not isinstance(f.dataType, (MapType, StructType))]
    size = index.agg(F.count("*").alias("n"), F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(8))).alias("bytes")).first()
    search = Search(index, vector, ordinal, limit, floor, pivots or min(MOST_PIVOTS, max(16, math.isqrt(size["n"]))), chunk)
    if len(wide) == len(fields) and (size["bytes"] or 0) <= small_bytes:
        return search.ranked(search.in_one(queries, search.index.toArrow()))
    return search.ranked(search.in_cells(durable(queries.select("query_id", "q"), "queries")))
