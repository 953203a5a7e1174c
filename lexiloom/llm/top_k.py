"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are put in the order of their lengths (ranges of the logarithm of the norm) and cut into blocks of
a bounded size, so a block is a bucket of like norms. Blocks are met in rounds of growing size, the longest
vectors first; between rounds each query's bound rises to its k-th score so far. A query needs vectors
longer than its bound divided by its own norm: queries are blocked by that need, and a block of vectors
goes only to the blocks of queries that it can reach. Where they meet, the bound divided by the query's
norm and the bucket's largest norm is a local cosine threshold: above 1 the bucket is skipped; if it is
high, coordinate pruning keeps the vectors whose largest-coordinate values lie in the ranges that the
threshold allows; else length pruning keeps the vectors long enough. What is left is verified by its
integer products, and the best k of each query go on.

Blocks travel in the narrowest integers that hold them. The work of an exact search still grows with
queries times vectors where lengths and coordinates prune little.

Defined results: each row is a vector of its own, so rows that repeat an id are all candidates, and queries
of their own if the id asks (each gives its rows); only the very row of the query is left out. Vectors that
are null or hold null or non-finite components take no part, nor do rows with a null id; shorter vectors
count as filled with zeros, so an empty one has products of 0; of equal scores the smaller ids stay; fewer
candidates than k give all; an empty table gives no rows; components or products beyond 64 bits raise an
error; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

BLOCK = 4096  # vectors of a block
FIRST, GROWTH = 1 << 16, 16  # vectors of the first round, and how each later one grows
QUERIES = (4096, 1 << 16)  # least and most queries of a block
SHARD = 16  # blocks that one meeting task reads, at most
RANGE = 1.02  # norms of one level differ by this factor at most
COORDINATES, HIGH = 3, 0.8
FOUND = "q_key long, query_id long, vec_id long, score long"
KINDS = ("int8", "int16", "int32", "int64")


def quantised(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (integer components) and norm of the vectors that take part."""
    scaled = lambda x: F.floor(scale * x.cast("double"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    wide = F.exists(vector_col, lambda x: F.abs(scale * x.cast("double")) >= 2.0**63)
    own = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    v = F.when(wide, F.raise_error(F.lit("a component is beyond 64 bits")).cast("array<bigint>")).otherwise(F.transform(vector_col, lambda x: scaled(x).cast("long")))
    return own.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Arrays as the rows of an integer matrix, filled up with zeros."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), C.ragged(np.zeros(len(n), np.int64), n)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def narrow(m: np.ndarray) -> tuple[str, bytes]:
    """The narrowest kind that holds all of m, and its bytes."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    kind = next(k for k in KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, m.astype(kind).tobytes()


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer products, by the cheapest arithmetic that is exact for numbers of this size."""
    most = max(-int(q.min(initial=0)), int(q.max(initial=0))) * max(-int(v.min(initial=0)), int(v.max(initial=0))) * max(q.shape[1], 1)
    for kind, exact in ((np.float32, 24), (np.float64, 53)):
        if most < 1 << exact:
            return np.rint(q.astype(kind) @ v.astype(kind).T).astype(np.int64)
    if most < 1 << 63:
        return q @ v.T
    big = q.astype(object) @ v.astype(object).T
    if any(abs(x) >= 1 << 63 for x in big.flat):
        raise OverflowError("a product is beyond 64 bits")
    return big.astype(np.int64)


def best(score: np.ndarray, own: np.ndarray, v_ids: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of each row's k best that reach its bound (ties to the smaller id); `own`: what is left out."""
    least = bound
    if score.shape[1] > k + 1:  # one more, for the query's own row
        at = score.shape[1] - k - 1
        least = np.maximum(bound, np.partition(score, at, axis=1)[:, at])
    row, column = np.nonzero((score >= least[:, None]) & ~own)
    s = score[row, column]
    order = np.lexsort((v_ids[column], -s, row))
    row, column, s = row[order], column[order], s[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k], s[rank < k]


class Bucket:
    """Vectors of like norms, the longest first."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norm, kind="stable")
        self.keys, self.ids, self.v, self.norm, self.top = keys[order], ids[order], v[order], norm[order], float(norm.max(initial=0))
        self.columns = None

    def near(self, u: np.ndarray, cosine: float) -> np.ndarray:
        """Coordinate pruning: an angle to u under arccos(cosine) leaves each coordinate a range."""
        if self.columns is None:
            self.unit = self.v / np.maximum(self.norm, 1e-300)[:, None]
            self.columns = np.argsort(self.unit, axis=0)
            self.ordered = np.take_along_axis(self.unit, self.columns, axis=0)
        focus = np.argsort(-np.abs(u))[:COORDINATES]
        angle, turn = np.arccos(np.clip(u[focus], -1, 1)), np.arccos(min(1.0, cosine))
        low = np.where(angle + turn >= np.pi, -1.0, np.cos(np.minimum(np.pi, angle + turn))) - 1e-9
        high = np.where(angle <= turn, 1.0, np.cos(np.maximum(0, angle - turn))) + 1e-9
        a = [int(np.searchsorted(self.ordered[:, f], x)) for f, x in zip(focus, low, strict=True)]
        b = [int(np.searchsorted(self.ordered[:, f], x, "right")) for f, x in zip(focus, high, strict=True)]
        j = int(np.argmin(np.subtract(b, a)))
        at = self.columns[a[j] : b[j], focus[j]]
        for f, x, y in zip(focus, low, high, strict=True):
            at = at[(self.unit[at, f] >= x) & (self.unit[at, f] <= y)]
        return at


def meet(bucket: Bucket, keys: np.ndarray, q: np.ndarray, norm: np.ndarray, bound: np.ndarray, k: int):
    """Query row, vector row and score of what one bucket adds; bound: least score that counts, lowest integer if none."""
    none = np.iinfo(np.int64).min
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(bound == none, -np.inf, np.where(norm > 0, bound / np.where(norm > 0, norm, 1), np.where(bound > 0, np.inf, -np.inf)))
        need = need - 1e-9 * (1 + np.abs(need))
        local = np.where(need > 0, need / max(bucket.top, 1e-300), 0.0)
    plain = np.flatnonzero(local <= HIGH)
    plain = plain[np.argsort(need[plain], kind="stable")]
    for a in range(0, len(plain), 256):
        part = plain[a : a + 256]
        n = int(np.searchsorted(-bucket.norm, -need[part[0]], "right"))  # length pruning
        if n:
            row, column, s = best(products(q[part], bucket.v[:n]), keys[part, None] == bucket.keys[None, :n], bucket.ids[:n], bound[part], k)
            yield part[row], column, s
    for i in np.flatnonzero((local > HIGH) & (local <= 1)).tolist():
        at = bucket.near(q[i] / norm[i], float(local[i]))
        if len(at):
            _, column, s = best(products(q[i : i + 1], bucket.v[at]), keys[i : i + 1, None] == bucket.keys[None, at], bucket.ids[at], bound[i : i + 1], k)
            yield np.full(len(column), i), at[column], s


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest products."""
    spark = vectors.sparkSession
    tables = C.Tables(spark, "top-k")
    level = F.floor(F.log(F.greatest("norm", F.lit(1e-9))) / np.log(RANGE)).cast("int")
    own = quantised(vectors, scale).select(F.monotonically_increasing_id().alias("key"), "vec_id", "v", "norm", level.alias("level"))
    own = tables.written(own, "vectors")
    stats = own.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("queries")).first()
    width, n = max(stats["width"] or 0, 1), stats["n"]
    # one row for each level: some 4,000 at most, by the range of the numbers
    levels = sorted(((r["level"], r["count"]) for r in own.groupBy("level").count().collect()), reverse=True)
    before = np.cumsum([0, *(c for _, c in levels)]).tolist()
    levels = spark.createDataFrame([(l, b, c) for (l, c), b in zip(levels, before, strict=False)], "level int, before long, of_level long")
    edges = [FIRST * GROWTH**r for r in range(64) if FIRST * GROWTH**r < n]
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    placed = own.join(F.broadcast(levels), "level").withColumn("place", (F.col("before") + F.floor(share * F.col("of_level"))).cast("long"))
    turn = sum((F.when(F.col("place") >= e, 1).otherwise(0) for e in edges), F.lit(0))

    def pack_vectors(table: pa.Table) -> pa.Table:
        m = matrix(table.column("v"), width)
        kind, v = narrow(m)
        top = float(np.sqrt((m.astype(np.float64) ** 2).sum(1)).max()) * (1 + 1e-9)
        return pa.table({"turn": table.column("turn").slice(0, 1), "block": table.column("block").slice(0, 1), "top": [top], "keys": [table.column("key").to_numpy().tobytes()], "ids": [table.column("vec_id").to_numpy().tobytes()], "kind": [kind], "v": [v]})

    blocks = placed.select(turn.alias("turn"), F.floor(F.col("place") / BLOCK).alias("block"), "key", "vec_id", "v")
    blocks = tables.written(blocks.groupBy("turn", "block").applyInArrow(pack_vectors, "turn int, block long, top double, keys binary, ids binary, kind string, v binary"), "blocks")
    size = min(max(stats["queries"] // 64, QUERIES[0]), QUERIES[1])
    n_blocks = -(-stats["queries"] // size) or 1
    asking = own.where(is_query).select("key", F.col("vec_id").alias("query_id"), "v", "norm")

    def pack_queries(table: pa.Table) -> pa.Table:
        kind, q = narrow(matrix(table.column("v"), width))
        as_bytes = lambda c: [table.column(c).to_numpy().tobytes()]
        return pa.table({"query_block": table.column("query_block").slice(0, 1), "low": [float(table.column("need").to_numpy().min())], "keys": as_bytes("key"), "ids": as_bytes("query_id"), "bound": as_bytes("bound"), "norm": as_bytes("norm"), "kind": [kind], "v": [q]})

    def meeting(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if vectors.num_rows and queries.num_rows:
            read = lambda row, c, kind=np.int64: np.frombuffer(row[c], kind)
            as_matrix = lambda row: read(row, "v", row["kind"]).reshape(-1, width).astype(np.int64)
            own = queries.to_pylist()[0]
            keys, ids, bound, norm, q = read(own, "keys"), read(own, "ids"), read(own, "bound").copy(), read(own, "norm", np.float64), as_matrix(own)
            for row in sorted(vectors.to_pylist(), key=lambda r: (-r["top"], r["block"])):
                bucket = Bucket(read(row, "keys"), read(row, "ids"), as_matrix(row))
                for at, column, s in meet(bucket, keys, q, norm, bound, k):
                    found.append((keys[at], ids[at], bucket.ids[column], s))
                    count = np.bincount(at, minlength=len(keys))
                    full = np.flatnonzero(count >= k)  # the k-th of these raises the bound for the buckets to come
                    last = np.full(len(keys), np.iinfo(np.int64).max)
                    np.minimum.at(last, at, s)
                    bound[full] = np.maximum(bound[full], last[full])
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["q_key", "query_id", "vec_id", "score"])

    rank = F.row_number().over(W.partitionBy("q_key").orderBy(F.desc("score"), "vec_id"))
    result = spark.createDataFrame([], FOUND + ", rank int")
    lowest = F.lit(-(1 << 63)).cast("long")
    for r in range(len(edges) + 1):
        bounds = result.groupBy(F.col("q_key").alias("key")).agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
        queries = asking.join(bounds, "key", "left") if r else asking.withColumn("bound", F.lit(None).cast("long"))
        need = F.when(F.col("bound").isNull(), float("-inf")).when(F.col("norm") > 0, F.col("bound") / F.col("norm")).when(F.col("bound") > 0, float("inf")).otherwise(float("-inf"))
        queries = queries.withColumn("need", need.cast("double")).withColumn("bound", F.coalesce("bound", lowest))
        cuts = queries.approxQuantile("need", [i / n_blocks for i in range(1, n_blocks)], 0.001) if r and n_blocks > 1 else []
        if cuts:
            queries = queries.withColumn("span", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("need"))))
            of_span = queries.groupBy("span").agg(F.ceil(F.count("*") / size).alias("parts"))  # n_blocks rows at most
            block = F.col("span") + (n_blocks + 1) * F.pmod(F.xxhash64("key"), F.col("parts"))
            queries = queries.join(F.broadcast(of_span), "span").withColumn("query_block", block.cast("long"))
        else:
            queries = queries.withColumn("query_block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("long"))
        queries = tables.written(queries.groupBy("query_block").applyInArrow(pack_queries, "query_block long, low double, keys binary, ids binary, bound binary, norm binary, kind string, v binary"), f"queries{r}")
        lows = queries.select("query_block", "low").collect()  # one row for a block of queries
        reach = F.array(*(F.struct(F.lit(x["query_block"]).cast("long").alias("query_block"), F.lit(x["low"]).alias("low")) for x in lows)) if lows else F.expr("cast(array() as array<struct<query_block:bigint,low:double>>)")
        mine = blocks.where(F.col("turn") == r)
        many = -(-((edges[r] if r < len(edges) else n) - (edges[r - 1] if r else 0)) // BLOCK) or 1
        together = min(max(many // 64, 1), SHARD)
        copies = mine.withColumn("shard", F.floor(F.col("block") / together)).withColumn("query_block", F.explode(F.transform(F.filter(reach, lambda x: x["low"] * (1 - 1e-9) - 1e-9 <= F.col("top")), lambda x: x["query_block"])))
        pairs = copies.select(F.col("query_block").alias("of"), F.col("shard").alias("to")).distinct()
        tasks = min(max(len(lows), 1) * -(-many // together), 8192)
        deal = lambda df: df.repartition(tasks, "query_block", "shard").groupBy("query_block", "shard")
        near = deal(copies).cogroup(deal(queries.join(pairs, F.col("query_block") == F.col("of")).withColumn("shard", F.col("to") + 0).drop("of", "to"))).applyInArrow(meeting, FOUND)
        result = result.select("q_key", "query_id", "vec_id", "score").union(near).withColumn("rank", rank).where(F.col("rank") <= k)
        if r < len(edges):
            result = tables.written(result, f"best{r}")
    return result.select("query_id", "rank", "vec_id", "score")
