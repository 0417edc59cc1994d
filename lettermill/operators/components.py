"""Connected components by random local contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lettermill.session import durable, ship

#: So few edges (some MB) are finished in one task; the result is the same.
LOCAL_EDGES = 1 << 18


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that occurs in an edge.

    ``component`` is the smallest node of the component. Each round every node
    moves to the neighbour (or itself) with the smallest hash under that
    round's seed (in the first round: the smallest itself), and edges are
    renamed and de-duplicated. Hashing makes the
    number of left nodes fall by a constant factor whatever the shape of the
    graph, so a chain of n nodes takes O(log n) rounds, not n; once at most
    ``LOCAL_EDGES`` are left, one task finishes them. Rounds are
    written to the shared folder. Null ends and self-loops are ignored; hubs
    only meet partial aggregates and joins that AQE may split.
    """
    left = durable(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"), "links")
    nodes = left.where("a = b").select(F.col("a").alias("node"))
    left = durable(_canonical(left), "edges")
    moves: list[DataFrame] = []
    while n := left.count():
        if n <= LOCAL_EDGES:
            moves.append(durable(_finished(left), "moves"))
            break
        # the first round goes by the nodes themselves: stars about their smallest node end with it
        rank = (lambda c, k=len(moves): F.xxhash64(F.lit(k), c)) if moves else (lambda _: F.lit(0).cast("long"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(rank("a").alias("h"), F.col("a").alias("n"))
        move = durable(near.select(F.col("a").alias("from"), F.least(F.col("m"), own)["n"].alias("to")), "moves")
        moves.append(move)
        left = left.join(move.select(F.col("from").alias("a"), F.col("to").alias("ta")), "a").select("ta", "b")
        left = left.join(move.select(F.col("from").alias("b"), F.col("to").alias("tb")), "b")
        left = durable(_canonical(left.select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "edges")
    if not moves:
        return nodes.distinct().select("node", F.col("node").alias("component"))
    # Later rounds are geometrically smaller, so resolve from the last to the first.
    end = moves[-1]
    for move in reversed(moves[:-1]):
        end = move.join(end.select(F.col("from").alias("to"), F.col("to").alias("end")), "to", "left").select("from", F.coalesce("end", "to").alias("to"))
    end = durable(end, "labels")
    least = end.groupBy("to").agg(F.min("from").alias("component"))
    out = end.join(least, "to").select(F.col("from").alias("node"), F.least("component", "to").alias("component"))
    lonely = nodes.distinct().join(out.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return out.unionByName(lonely)


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _finished(edges: DataFrame) -> DataFrame:
    """``(from, to)`` for all nodes of a few edges: one node of its component."""
    kind = edges.schema["a"].dataType
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), edges_schema)
        if not table.num_rows:
            return
        ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
        ends = ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends
        x, y = np.split(ends.indices.to_numpy().astype(np.int64), 2)
        label = np.arange(len(ends.dictionary))
        while len(x):
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            while not np.array_equal(label, label[label]):
                label = label[label]
            open_ = label[x] != label[y]
            x, y = x[open_], y[open_]
        yield pa.RecordBatch.from_arrays([ends.dictionary, ends.dictionary.take(pa.array(label))], ["from", "to"])

    from pyspark.sql.pandas.types import to_arrow_schema

    edges_schema = to_arrow_schema(edges.select("a", "b").schema)
    return edges.select("a", "b").repartition(1).mapInArrow(run, StructType([StructField("from", kind), StructField("to", kind)]))
