"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.store import cut_lineage

#: Distinct vectors, and query vectors, that meet in one task at most (about).
BLOCK = 1 << 17


class PStable:
    """Tables of p-stable hash functions floor((a.x + b) / width) over unit vectors."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, probes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((dim, tables * functions))
        self.b = rng.uniform(0, width, tables * functions)
        self.tables, self.functions, self.width, self.probes = tables, functions, width, probes
        step = range(-1, 2)
        self.moves = np.array([m for m in itertools.product(step, repeat=functions)])

    def _cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = (x @ self.a + self.b) / self.width
        cell = np.floor(y)
        shape = (len(x), self.tables, self.functions)
        return cell.astype(np.int64).reshape(shape), (y - cell).reshape(shape)

    def _key(self, cells: np.ndarray) -> np.ndarray:
        key = np.zeros(cells.shape[:-1], np.int64)
        for j in range(self.functions):
            key = key * 1_000_003 + cells[..., j]
        return key

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """rows x tables: the bucket of each vector."""
        return self._key(self._cells(x)[0])

    def probe(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x probes: buckets in the order of estimated success.

        A move by one cell costs the square of the distance to that side, as a near neighbour's projection is normal
        around the query's; the moves of least total cost come first, the own bucket, of no cost, before all."""
        cell, part = self._cells(x)
        cost = (self.moves == -1) * part[:, :, None, :] ** 2 + (self.moves == 1) * (1 - part[:, :, None, :]) ** 2
        cost = cost.sum(-1)
        n = min(self.probes, len(self.moves))
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :n]
        return self._key(cell[:, :, None, :] + self.moves[best])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(df: DataFrame, index: PStable, id_col: str, probing: bool) -> DataFrame:
    """(table, bucket, id, v): a row for each bucket that a vector lies in or, for queries, visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 64 if probing else 2048  # a query weighs 3 ** functions moves in every table
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                x = _matrix(part.column("v"))
                keys = index.probe(x / _norm(x)) if probing else index.buckets(x / _norm(x))[:, :, None]
                per = keys.shape[1] * keys.shape[2]
                row = pa.array(np.repeat(np.arange(len(x)), per))
                table = np.tile(np.repeat(np.arange(keys.shape[1], dtype=np.int32), keys.shape[2]), len(x))
                yield pa.RecordBatch.from_arrays([pa.array(table), pa.array(keys.reshape(-1)), part.column("id").take(row), part.column("v").take(row)], ["table", "bucket", "id", "v"])

    own = df.select(F.col(id_col).alias("id"), "v")
    kind = own.schema["v"].dataType.simpleString()
    return own.mapInArrow(run, f"table int, bucket long, id long, v {kind}")


def _best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k nearest of `right` to each query in `left`, by cosine in double precision, ties to the smaller id."""
    q, c = left.column("id").to_numpy(), right.column("id").to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(q) and len(c):
        order = np.argsort(c, kind="stable")
        c = c[order]
        y = _matrix(right.column("v").combine_chunks())[order]
        x = _matrix(left.column("v").combine_chunks())
        yn, n = _norm(y)[:, 0], min(k, len(c))
        for lo in range(0, len(q), 256):
            xs = x[lo : lo + 256]
            score = (xs @ y.T) / (_norm(xs) * yn[None])
            # All that reach the k-th best value, so that ties are settled by id and not by the partition.
            floor = np.partition(score, len(c) - n, axis=1)[:, len(c) - n] - 1e-12
            i, j = np.nonzero(score >= floor[:, None])
            s = score[i, j]
            rank = np.lexsort((c[j], -s, i))
            i, j, s = i[rank], j[rank], s[rank]
            within = np.arange(len(i)) - np.searchsorted(i, i)
            top = within < k + 1
            out.append((q[lo + i[top]], c[j[top]], s[top]))
    cols = [np.concatenate([o[t] for o in out]) if out else np.zeros(0, kind) for t, kind in enumerate((np.int64, np.int64, np.float64))]
    return pa.table({"q": pa.array(cols[0], pa.int64()), "c": pa.array(cols[1], pa.int64())})


def usable(vector: Column) -> Column:
    """Whether a vector is there, has only finite components and isn't zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """In double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = 8, functions: int = 6, width: float = 2.0, probes: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that are found of each row for which is_query holds, by largest
    cosine, among all rows but its own.

    Equal vectors are searched for and found once: a group of equal candidates stands for its k + 1 smallest ids, as no
    query can need more. Each distinct vector lies in one bucket of every table; each distinct query visits `probes`
    buckets of every table, likeliest first. A bucket's vectors and visitors are dealt out in blocks and scored together,
    and only the best of each block leave it. Queries that reach less than k others that way are scored against all rows.
    All rows are indexed; no bucket is cut.

    Vectors that are null, zero, or hold a null or non-finite component, or have another length than most, take no part.
    Ties go to the smaller id. Rows that repeat an id count once for each different vector. An empty table, or one
    without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    dim = lengths[0]["n"]
    own = own.where(F.size("v") == dim)
    ranked = Window.partitionBy("v").orderBy("id")
    groups = own.select("id", "v").distinct().withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k + 1)
    groups = cut_lineage(groups.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")))
    asked = own.where("q").select("id", "v").distinct()
    asked = cut_lineage(asked.join(groups.select(F.col("v").alias("v2"), F.col("id").alias("g")), F.col("v") == F.col("v2")).select("id", "g", "v"))
    queries = asked.groupBy("g").agg(F.first("v").alias("v"))
    rows, n_queries = groups.count(), queries.count()
    blocks, sheets = -(-rows // BLOCK) or 1, -(-n_queries // BLOCK) or 1

    index = PStable(dim, tables, functions, width, probes)
    best = k + 1
    scored = "q long, c long"

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, best)

    def dealt(df: DataFrame, block: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn(block, F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    by = ("table", "bucket", "block", "sheet")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = dealt(left, "sheet", sheets, "block", blocks), dealt(right, "block", blocks, "sheet", sheets)
        return left.withColumn("block", F.col("block").cast("long")).groupBy(*by).cogroup(right.withColumn("sheet", F.col("sheet").cast("long")).groupBy(*by)).applyInArrow(meet, scored)

    found = met(_hashed(queries, index, "g", True), _hashed(groups, index, "id", False))
    found = cut_lineage(found.distinct())
    # Few found: the query's own group and at least k others are wanted, or all there are.
    enough = found.groupBy("q").count().where(F.col("count") >= min(best, rows))
    few = queries.join(enough, queries["g"] == enough["q"], "left_anti")
    whole = lambda df, name: df.select(F.lit(-1).alias("table"), F.lit(0).cast("long").alias("bucket"), F.col(name).alias("id"), "v")
    few = cut_lineage(few)
    if few.limit(1).count():
        found = found.unionByName(met(whole(few, "g"), whole(groups, "id"))).distinct()

    # Exact scores of what was found, on the original vectors; then the best groups of each distinct query.
    pair = found.join(queries.select(F.col("g").alias("q"), F.col("v").alias("qv")), "q").join(groups.select(F.col("id").alias("c"), F.col("v").alias("cv"), "ids"), "c")
    pair = pair.select("q", "c", "ids", cosine(F.col("qv"), F.col("cv")).alias("score"))
    pair = pair.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1)))).where(F.col("_n") <= best)
    listed = pair.select(F.col("q").alias("g"), "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("_n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= best)
    near = listed.groupBy("g").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("c")))).alias("near"))
    out = asked.select(F.col("id").alias("query_id"), "g").join(near, "g")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["c"] != F.col("query_id")), 1, k)).alias("_p", "_x"))
    return out.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.c").alias("vec_id"), (-F.col("_x.s")).alias("score"))
