"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and get one more component, so that the nearest by Euclidean distance is
the largest by inner product. Each of TABLES tables hashes with HASHES random normal projections cut into steps of WIDTH.
A query visits, in each table, the PROBES perturbed buckets of least summed squared distance to the bucket bounds that
it would cross, which orders them by estimated success; the candidates of all tables are merged and ranked by their exact inner products.

Queries meet all rows in blocks of fixed size: a task holds one block of rows with its tables and one block of queries, and the
best of each block are merged by a window whose input is TOP rows a block. A block is dealt by hash of vec_id and vector, so equal
vectors are spread, and a bucket that holds many of them is ranked whole: there is no cap.

Cases: null, empty or zero vectors and those with a null, NaN or infinite component take no part; vectors meet only those of
their own length; ties go to the smaller vec_id; of a repeated vec_id each row is a query with ranks of its own and a candidate of all others, the
row itself alone left out (equal rows are searched for once); null vec_ids take no part; fewer
candidates than TOP are all given that were visited, and where the visited ones are fewer than TOP the whole block is ranked; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, TABLES, HASHES, PROBES, WIDTH = 20, 8, 5, 120, 1.2
ROWS_A_BLOCK, QUERIES_A_BLOCK = 1 << 15, 512


@functools.cache
def _family(dimension: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(dimension))
    return draw.normal(size=(tables, dimension, hashes)), draw.uniform(0, width, (tables, hashes))


class Tables:
    """The hash tables of one block of unit-ball vectors."""

    def __init__(self, points: np.ndarray, tables: int, hashes: int, width: float):
        self.normal, self.offset = _family(points.shape[1], tables, hashes, width)
        self.width, self.steps = width, np.array(list(itertools.product((-1, 0, 1), repeat=hashes)))
        self.kept = []
        for normal, offset in zip(self.normal, self.offset, strict=True):
            bucket = np.floor((points @ normal + offset) / width).astype(np.int64)
            least, sides = bucket.min(axis=0), np.ptp(bucket, axis=0) + 1
            code = (bucket - least) @ self._radix(sides)
            order = np.argsort(code, kind="stable")
            self.kept.append((least, sides, order, code[order]))

    @staticmethod
    def _radix(sides: np.ndarray) -> np.ndarray:
        return np.concatenate([[1], np.cumprod(sides[:-1])])

    def visit(self, query: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of the points in the visited buckets of all tables."""
        found = []
        for normal, offset, (least, sides, order, codes) in zip(self.normal, self.offset, self.kept, strict=True):
            at = (query @ normal + offset) / self.width
            bucket = np.floor(at)
            inside = at - bucket
            cost = np.where(self.steps < 0, inside**2, np.where(self.steps > 0, (1 - inside) ** 2, 0.0)).sum(axis=1)
            chosen = np.argsort(cost, kind="stable")[:probes]
            near = bucket.astype(np.int64) + self.steps[chosen] - least
            near = near[((near >= 0) & (near < sides)).all(axis=1)] @ self._radix(sides)
            low, high = np.searchsorted(codes, near, "left"), np.searchsorted(codes, near, "right")
            found += [order[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a]
        mask = np.zeros(len(self.kept[0][2]), bool)
        for part in found:
            mask[part] = True
        return np.flatnonzero(mask)


def best(ids: np.ndarray, vectors: np.ndarray, candidates: np.ndarray, query: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and exact inner products of the top candidates."""
    scores = vectors[candidates] @ query
    if len(scores) > top:
        bound = np.partition(scores, len(scores) - top)[len(scores) - top]
        keep = scores >= bound - 1e-9 * (1 + abs(bound))
        candidates = candidates[keep]
    exact = (vectors[candidates] * query).sum(axis=1)
    order = np.lexsort((ids[candidates], -exact))[:top]
    return ids[candidates[order]], exact[order]


def _lifted(vectors: np.ndarray, largest: float, query: bool) -> np.ndarray:
    scaled = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) if query else largest)
    extra = np.zeros((len(scaled), 1)) if query else np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))
    return np.concatenate([scaled, extra], axis=1)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, query_every: int, top: int = TOP, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, width: float = WIDTH) -> DataFrame:
    """vectors (vec_id, embedding) -> (query_id, rank, vec_id, score); queries: the rows whose vec_id query_every divides."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    is_query = F.col("vec_id") % query_every == 0
    seen = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(squares).alias("m")).first()
    row_blocks, query_blocks = math.ceil(seen.n / ROWS_A_BLOCK) or 1, math.ceil(seen.q / QUERIES_A_BLOCK) or 1
    largest = math.sqrt(seen.m or 1.0)
    dealt, every = F.xxhash64("vec_id", "v"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.withColumns({"size": F.size("v"), "row_block": F.pmod(dealt, F.lit(row_blocks)).cast("int")}).withColumn("query_block", every(query_blocks))
    # Equal query rows have equal neighbours: one of them is searched for, for all.
    asked = rows.where(is_query).groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumns({"size": F.size("v"), "query_block": F.pmod(dealt, F.lit(query_blocks)).cast("int")}).withColumn("row_block", every(row_blocks))

    def meet(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(queries):
            ids, points = held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy())
            found = Tables(_lifted(points, largest, False), tables, hashes, width)
            wanted = np.stack(queries["v"].to_numpy())
            copies = queries["copies"].to_numpy()
            for number, (key, query, lifted) in enumerate(zip(queries["vec_id"].to_numpy(), wanted, _lifted(wanted, largest, True), strict=True)):
                candidates, itself = found.visit(lifted, probes), np.flatnonzero(ids == key)
                itself = itself[(points[itself] == query).all(axis=1)][:1]  # the one row that asks
                candidates = candidates[~np.isin(candidates, itself)]
                if len(candidates) < top:
                    candidates = np.delete(np.arange(len(ids)), itself)
                near, score = best(ids, points, candidates, query, top)
                out.append(pd.DataFrame({"query_id": key, "variant": xxhash.xxh3_64_intdigest(query.tobytes()) - 2**63, "copies": copies[number], "vec_id": near, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({x: [] for x in ("query_id", "variant", "copies", "vec_id", "score")})

    blocks = ["size", "row_block", "query_block"]
    met = data.groupBy(*blocks).cogroup(asked.groupBy(*blocks)).applyInPandas(meet, "query_id long, variant long, copies long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id"))
    ranked = met.withColumn("rank", rank).where(F.col("rank") <= top)
    each = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("query_id", "rank", "vec_id", "score")
