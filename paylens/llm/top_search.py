"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists, one for each dimension.

Vectors become integers, so that scores are exact and ties are ties. Rows are
dealt over blocks by a hash of their vector; each block sorts its rows once in
every dimension. A query reads the lists of the dimensions in which it is not
zero, from the end that adds most to its score, to the same depth in all of
them; what it meets for the first time is scored in full. No row that it has
not met can score more than the threshold, the score of a row made of the last
values read. The search of a block ends when the threshold is below the kth
score; at equality it goes on, for a row of a smaller id may tie.

Blocks are searched in phases of 32, 1024, 32768 ... blocks. The kth score of
the phases before is a bound that the next ones begin with, so they read less
and return few rows; what a query returns altogether does not grow with the
number of blocks. Queries are streamed through the blocks, a block is all that
a task holds.

Copies of one vector tie in every search, so only the k + 1 copies of the
smallest ids can be returned (one may be the query itself): the others leave
before blocks are made, in the tasks that read them.

Null vectors and those with a null, infinite or NaN component take no part. A
vector meets those of its own length; of none, the scores are 0. Ids order
ties, a null id comes last and is never a query. Rows that repeat an id are rows
of their own: a query leaves out its own row only. A component or a score that
is no 64-bit integer raises. A table without rows or queries returns none.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import map_rows, prepare

#: Rows of a block, at most on the average and at least if there are enough.
LARGEST, SMALLEST = 65_536, 4_096
#: Blocks of the first phase, and by how much each phase grows.
PHASE = 32
#: Entries of each list that are read at first; later ones read half as many as before in addition.
FIRST = 64
_NO_ID = np.iinfo(np.int64).max


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the components of the vectors that take part."""
    vector = F.col(vector_col)
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(vector.isNotNull()).where(finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )


class Lists:
    """The rows of a block that have one length, and their order in each dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.most = float(np.abs(values.astype(np.float64)).max(initial=0))
        # Sums of products below 2 ** 53 are exact as doubles, which numpy multiplies much faster.
        self.doubles = values.astype(np.float64) if self.most < 2**26 else None
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T.astype(np.int32))

    def table(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound = self.most * float(np.abs(query.astype(np.float64)).sum())
        if bound < 2**53 and self.doubles is not None:
            return self.doubles, query.astype(np.float64)
        if bound >= 2**63:
            raise OverflowError("a score is beyond 64 bits")
        return self.values, query

    def search(self, query: np.ndarray, own: int, k: int, bound: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows but the query's own, by score and then id; none below the bound."""
        n = len(self.ids)
        seen = np.zeros(n, bool)
        twins = np.flatnonzero(self.ids == own)
        for row in twins[(self.values[twins] == query).all(1)][:1]:
            seen[row] = True
        ups, downs = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        if not len(ups) and not len(downs):
            # No list to read: all scores are 0, and ids decide.
            left = np.sort(self.ids[~seen])[:k]
            return np.zeros(len(left), np.int64), left if bound is None or bound <= 0 else left[:0]
        table, q = self.table(query)
        scores, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        least = bound
        depth, to = 0, min(n, FIRST)
        while True:
            met = np.zeros(n, bool)
            met[self.order[ups, n - to : n - depth]] = True
            met[self.order[downs, depth:to]] = True
            met &= ~seen
            seen |= met
            rows = np.flatnonzero(met)
            found = (table[rows] @ q).astype(np.int64)
            if least is not None:
                good = found >= least
                rows, found = rows[good], found[good]
            if len(rows):
                scores, ids = np.concatenate([scores, found]), np.concatenate([ids, self.ids[rows]])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                if len(scores) == k:
                    least = int(scores[-1]) if least is None else max(least, int(scores[-1]))
            if to == n:
                return scores, ids
            threshold = q[ups] @ table[self.order[ups, n - to], ups] + q[downs] @ table[self.order[downs, to - 1], downs]
            if least is not None and threshold < least:
                return scores, ids
            depth, to = to, min(n, to + max(FIRST, to // 2))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, starts and values of a column of lists."""
    lengths = np.diff(column.offsets.to_numpy())
    return lengths, np.cumsum(lengths) - lengths, column.flatten().to_numpy(zero_copy_only=False)


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """Results of the queries of each block from the rows of that block, which come before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        block, held, lists = None, {}, None
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("query_id", "query", "copies", "vec_id", "score")}
            lengths, starts, values = _matrix(batch.column("v"))
            ids = batch.column("vec_id").fill_null(_NO_ID).to_numpy()
            columns = (batch.column(c).to_pylist() for c in ("block", "ask", "query", "copies", "bound"))
            for i, (here, ask, query, copies, bound) in enumerate(zip(*columns)):
                if here != block:
                    block, held, lists = here, {}, None
                vector = values[starts[i] : starts[i] + lengths[i]]
                if not ask:
                    held.setdefault(len(vector), []).append((ids[i], vector))
                    continue
                if lists is None:
                    lists = {
                        n: Lists(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), n))
                        for n, rows in held.items()
                    }
                    held = {}
                if len(vector) not in lists:
                    continue
                scores, found = lists[len(vector)].search(vector.astype(np.int64), int(ids[i]), k, bound)
                out["query_id"] += [int(ids[i])] * len(found)
                out["query"] += [query] * len(found)
                out["copies"] += [copies] * len(found)
                out["vec_id"] += [None if f == _NO_ID else f for f in found.tolist()]
                out["score"] += scores.tolist()
            yield out

    return map_rows(rows, "query_id long, query long, copies long, vec_id long, score long", run)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query among ``vectors`` (vec_id, v).

    ``is_query`` tells of ``vec_id`` which rows are queries. Rank counts from 1,
    by score and then id.
    """
    spark = prepare(vectors.sparkSession)
    copy = F.row_number().over(Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last()))
    rows = vectors.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "v").checkpoint()
    asked = (
        vectors.where(is_query & F.col("vec_id").isNotNull())
        .groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
        .select("vec_id", "v", "copies", F.xxhash64("v").alias("query"))
        .checkpoint()
    )
    n = rows.count()
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // LARGEST), min(wanted, -(-n // SMALLEST)))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)))
    best, bounds = None, None
    done, upto = 0, min(blocks, PHASE)
    by_rank = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    while done < blocks:
        none = F.lit(None).cast("long")
        data = placed.where((F.col("block") >= done) & (F.col("block") < upto)).select(
            "block", F.lit(False).alias("ask"), "vec_id", "v", none.alias("query"), none.alias("copies"), none.alias("bound")
        )
        known = asked.withColumn("bound", none) if bounds is None else asked.join(bounds, ["vec_id", "query"], "left")
        block = F.explode(F.sequence(F.lit(done).cast("long"), F.lit(upto - 1).cast("long")))
        through = known.select(block.alias("block"), F.lit(True).alias("ask"), "vec_id", "v", "query", "copies", "bound")
        dealt = data.unionByName(through).repartitionByRange(upto - done, "block").sortWithinPartitions("block", "ask")
        found = _searched(dealt, k)
        merged = found if best is None else found.unionByName(best)
        ranked = merged.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
        best = ranked.select("query_id", "query", "copies", "vec_id", "score").checkpoint()
        kth = F.when(F.count("*") == k, F.min("score")).alias("bound")
        bounds = best.groupBy(F.col("query_id").alias("vec_id"), "query").agg(kth)
        done, upto = upto, min(blocks, upto * PHASE)
    ranked = best.withColumn("rank", F.row_number().over(by_rank))
    # A row that repeats a query is a query of its own, with the same results.
    each = ranked.withColumn("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
