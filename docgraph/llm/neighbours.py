"""Nearest neighbours by multiprobe p-stable hashing.

Each of `TABLES` tables hashes a normalised vector to floor((a_i x + b_i) / width) for some Gaussian
directions a_i. A query visits its own bucket and those that differ by one step in up to `CHANGES` directions, in
the order of their estimated success: the sum of squared distances to the crossed borders, least first.
Candidates of all tables are reranked by exact cosine in double precision.

A query visits `PROBES` buckets of each table, whatever the data. Number of directions and width are fitted: `FIT_QUERIES` queries (chosen by hash) are compared with all rows, and of the
plans that find `RECALL` of their true neighbours the one is taken that visits the least share of `FIT_ROWS` rows (chosen by hash). So recall is
measured on the data at hand, and the share of candidates follows how near neighbours are: half of all rows on isotropic vectors, which
have no near neighbours, and well under a hundredth on clustered ones (README). Every row is indexed.

Nothing is paired in rows: index rows and probes meet in shards of buckets, each shard compares a bucket's
queries with its vectors in blocks and returns the best `k` of each query; these lists are merged.
A shard holds about `SHARD_BYTES` of vectors, however many there are, and a bucket with more than `PART` vectors is split over several shards, so
copies of one vector or a hot direction don't land in one task; every part returns its best k, so nothing is lost.
A query that finds fewer than `k` candidates, although there are more, is compared with all vectors, in blocks.

Rows are told apart by a number of their own, not by vec_id: of rows with one vec_id each is a query and a candidate. Vectors are compared with those of
the same length, one search for each length. Null, empty and zero vectors, vectors with null or non-finite components, and rows without vec_id
take no part. Vectors are scaled by a power of two first, so huge and tiny components keep exact cosines. Equal scores go by vec_id. Empty tables
give no rows. Further columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import checkpointed

TABLES = 8
PART = 4096
CHANGES = 3
PROBES = 300
#: Bytes of vectors in a shard, and in a block where queries are compared with all vectors.
SHARD_BYTES = 32 << 20
BLOCK_BYTES = 8 << 20
SEED = 7
#: Bounds of the fit, the plans it tries (widths as multiples of the distance to the k-th neighbour), and the share of neighbours to find.
FIT_QUERIES = 96
FIT_ROWS = 512
HASHES = (8, 12, 16)
WIDTHS = (1.25, 1.5, 2.0, 2.5, 3.0, 3.3, 3.6, 4.0)
RECALL = 0.95


def perturbations(hashes: int) -> np.ndarray:
    """All steps by -1, 0 and +1 with at most CHANGES steps that aren't 0."""
    out = []
    for r in range(CHANGES + 1):
        for at in itertools.combinations(range(hashes), r):
            for signs in itertools.product((-1, 1), repeat=r):
                out.append([0] * hashes)
                for i, sign in zip(at, signs, strict=True):
                    out[-1][i] = sign
    return np.array(out, np.int64)


class Family:
    """The hash functions of all tables, from a fixed seed."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.a = rng.normal(size=(tables, dim, hashes))
        self.b = rng.uniform(0, width, (tables, 1, hashes))
        self.width, self.hashes = width, hashes
        self.steps = perturbations(hashes)

    def places(self, x: np.ndarray) -> np.ndarray:
        """tables x rows x hashes, unrounded."""
        return (x @ self.a + self.b) / self.width

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        out = np.full(cells.shape[:-1], table + 1, np.uint64)
        for i in range(cells.shape[-1]):
            out = K.mix(out * K.U64(0x9E3779B97F4A7C15) + cells[..., i].astype(np.uint64))
        return out

    def costs(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row (one table): squared distances to the borders (rows x step + 1 x hashes), and their sum for each perturbation."""
        into = place - np.floor(place)
        cost = np.stack((into**2, np.zeros_like(into), (1 - into) ** 2), 1)
        total = np.zeros((len(place), len(self.steps)))
        for i in range(self.hashes):
            total += cost[:, :, i][:, self.steps[:, i] + 1]
        return cost, total

    def probes(self, place: np.ndarray, n: int) -> np.ndarray:
        """Cells of the n likeliest buckets of each row, likeliest first (one table)."""
        _, total = self.costs(place)
        n = min(n, total.shape[1])
        order = np.argpartition(total, n - 1, axis=1)[:, :n]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(total, order, 1), axis=1, kind="stable"), 1)
        return np.floor(place).astype(np.int64)[:, None, :] + self.steps[order]

    def visits(self, queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """How many probes of each table until query q meets row r: the least over the tables."""
        out = np.full(len(q), np.inf)
        for mine, other in zip(self.places(queries), np.floor(self.places(rows)), strict=True):
            step = (other[r] - np.floor(mine)[q]).astype(np.int64)
            near = np.flatnonzero((np.abs(step).max(axis=1) <= 1) & ((step != 0).sum(axis=1) <= CHANGES))
            cost, total = self.costs(mine)
            total.sort(axis=1)
            own = sum(cost[q[near], step[near, i] + 1, i] for i in range(self.hashes))
            for i in np.unique(q[near]):
                at = near[q[near] == i]
                out[at] = np.minimum(out[at], np.searchsorted(total[i], own[q[near] == i] - 1e-12) + 1)
        return out


class Plan:
    """The fitted numbers, and what the sample says of them."""

    def __init__(self, hashes: int, width: float, recall: float, share: float):
        self.hashes, self.width, self.recall, self.share = hashes, width, recall, share


def choose(queries: np.ndarray, near: np.ndarray, of: np.ndarray, rows: np.ndarray, tables: int, recall: float) -> Plan:
    """The plan with the least share of rows among those that find enough neighbours; near: neighbours of queries[of]. All are unit vectors."""
    gap = np.sqrt(np.maximum(0, 2 - 2 * (queries[of] * near).sum(axis=1)))
    base = max(float(np.median(gap)), 1e-6) if len(gap) else 1.0
    q, r = np.divmod(np.arange(len(queries) * len(rows)), max(1, len(rows)))
    plans = []
    for hashes, width in itertools.product(HASHES, WIDTHS):
        family = Family(queries.shape[1], tables, hashes, width * base)
        found, met = family.visits(queries, near, of, np.arange(len(near))), family.visits(queries, rows, q, r)
        plans.append(Plan(hashes, width * base, float((found <= PROBES).mean()) if len(found) else 1.0, float((met <= PROBES).mean()) if len(met) else 0.0))
    return min(plans, key=lambda p: (max(0.0, recall - p.recall), p.share, p.hashes))


def _scaled(raw: pa.ChunkedArray | pa.Array, dim: int, kind: type) -> np.ndarray:
    """Vectors in double precision, each scaled by a power of two, so that its largest component is between 1/2 and 1."""
    x = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _units(raw: pa.ChunkedArray | pa.Array, dim: int, kind: type) -> np.ndarray:
    x = _scaled(raw, dim, kind)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _clean(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, type]:
    """id, v (binary), row (a number of its own) of the vectors that take part, written, so that the numbers stay; and the type of components."""
    kind = np.float32 if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else np.float64
    array = "array<float>" if kind is np.float32 else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, out = [], []
            for i, v in zip(rows.column(0).to_pylist(), rows.column(1).to_numpy(zero_copy_only=False), strict=True):
                x = np.asarray([] if v is None else v, np.float64)
                if i is not None and len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i), out.append(x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])

    made = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(array).alias("v")).mapInArrow(run, "id long, v binary")
    return checkpointed(made.withColumn("row", F.monotonically_increasing_id())), kind


def fit(rows: DataFrame, queries: DataFrame, dim: int, kind: type, k: int, tables: int, recall: float) -> Plan:
    """A plan for rows and queries (id, v, row) of one length."""

    def sample(df: DataFrame, n: int, salt: int) -> pa.Table:
        return df.orderBy(F.xxhash64("row", F.lit(salt)), "row").limit(n).select("row", "v").toArrow()

    some, other = sample(queries, FIT_QUERIES, 0), sample(rows, FIT_ROWS, 1)
    wanted, own = _units(some.column("v"), dim, kind), some.column("row").to_numpy()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = np.full((len(own), 0), -9.0), np.zeros((len(own), 0), np.int64)
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                here = np.asarray(part.column(0))
                score = wanted @ _units(part.column(1), dim, kind).T
                score[own[:, None] == here] = -9
                best, at = np.concatenate((best, score), 1), np.concatenate((at, np.broadcast_to(here, score.shape)), 1)
                top = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, at = np.take_along_axis(best, top, 1), np.take_along_axis(at, top, 1)
        q, _ = np.nonzero(best > -5)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[best > -5]), pa.array(at[best > -5])], names=["q", "score", "row"])

    # k rows of each query and task, without vectors
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "row"))), 1, k)["row"]
    lists = rows.select("row", "v").mapInArrow(nearest, "q long, score double, row long").groupBy("q").agg(first.alias("near")).collect()
    pairs = [(r["q"], n) for r in lists for n in r["near"]]
    # at most FIT_QUERIES * k rows
    ids = rows.sparkSession.createDataFrame([(n,) for n in {n for _, n in pairs}], "row long")
    near = rows.join(F.broadcast(ids), "row", "left_semi").select("row", "v").toArrow()
    place = {n: i for i, n in enumerate(near.column("row").to_pylist())}
    units = _units(near.column("v"), dim, kind)[[place[n] for _, n in pairs]] if pairs else np.zeros((0, dim))
    return choose(wanted, units, np.array([q for q, _ in pairs], np.int64), _units(other.column("v"), dim, kind), tables, recall)


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """The k nearest found of each query (a condition on `id`): query_id, rank, vec_id, score."""
    clean, kind = _clean(vectors, vec_id, vector)
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size, n in sorted(tuple(r) for r in clean.groupBy(F.octet_length("v")).count().collect()):
        rows = clean.where(F.octet_length("v") == size)
        out = out.unionByName(_search(rows, rows.where(is_query), n, size // np.dtype(kind).itemsize, kind, k, tables, recall))
    return out


def _search(rows: DataFrame, queries: DataFrame, n: int, dim: int, kind: type, k: int, tables: int, recall: float) -> DataFrame:
    """search() for rows and queries (id, v, row) of one length."""
    plan = fit(rows, queries, dim, kind, k, tables, recall)

    def hashed(with_vectors: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            family = Family(dim, tables, plan.hashes, plan.width)
            for batch in batches:
                for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                    place = np.floor(family.places(_units(part.column(2), dim, kind))).astype(np.int64)
                    for t in range(tables):
                        bucket = pa.array(K.signed(family.keys(place[t], t)))
                        yield pa.RecordBatch.from_arrays([bucket, *part.columns] if with_vectors else [bucket], names=["bucket", "row", "id", "v"][: 4 if with_vectors else 1])

        return run

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(dim, tables, plan.hashes, plan.width)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                place = family.places(_units(part.column(1), dim, kind))
                for t in range(tables):
                    keys = family.keys(family.probes(place[t], PROBES), t)
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(keys.reshape(-1))), pa.array(np.repeat(np.asarray(part.column(0)), keys.shape[1]))], names=["bucket", "row"])

    source = rows.select("row", "id", "v")
    buckets = checkpointed(source.mapInArrow(hashed(False), "bucket long").groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    split = buckets.where("parts > 1")
    # a row for PART vectors of a table: beyond a million, Spark chooses the join itself
    split = F.broadcast(split) if split.count() <= 1_000_000 else split
    shards = F.lit(max(16, -(-n * tables * dim * np.dtype(kind).itemsize // SHARD_BYTES)))
    shard = F.pmod(F.xxhash64("bucket", "part"), shards).cast("int").alias("shard")
    index = source.mapInArrow(hashed(True), "bucket long, row long, id long, v binary").join(split, "bucket", "left")
    placed = index.withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")).select(shard, "bucket", "row", "id", "v")
    visits = queries.select("row", "v").mapInArrow(probed, "bucket long, row long").join(buckets, "bucket")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(shard, "bucket", "row")
    visits = visits.groupBy("shard", "row").agg(F.collect_set("bucket").alias("buckets")).join(queries, "row")

    def best(query: np.ndarray, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Positions of each query's first k by falling score, then id, without repeats of a row."""
        order = np.lexsort((row, ids, -score, query))
        q, i = query[order], row[order]
        new = np.ones(len(order), bool)
        new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])  # one row has one score and id, so its repeats are neighbours
        order, q = order[new], q[new]
        head = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        return order[rank < k]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        held: tuple[np.ndarray, ...] = (none, none, none, np.zeros(0))
        names: dict[int, int] = {}
        if left.num_rows and right.num_rows:
            x, y = (_scaled(t.column("v"), dim, kind) for t in (left, right))
            nx, ny = (np.sqrt((z * z).sum(axis=1)) for z in (x, y))
            ids, lrow, qrow = left.column("id").to_numpy(), left.column("row").to_numpy(), right.column("row").to_numpy()
            names = dict(zip(qrow.tolist(), right.column("id").to_pylist(), strict=True))
            bucket = left.column("bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            wanted = right.column("buckets").to_pylist()
            who = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
            what = np.array([b for w in wanted for b in w], np.int64)
            by = np.argsort(what, kind="stable")
            who, what = who[by], what[by]
            gathered: list[tuple[np.ndarray, ...]] = []
            size = 0

            def settle() -> tuple[np.ndarray, ...]:
                got = tuple(np.concatenate(c) for c in zip(held, *gathered, strict=True))
                at = best(*got)
                return tuple(g[at] for g in got)

            for lo, hi in zip(*_groups(bucket[order]), strict=True):
                b = bucket[order[lo]]
                q = who[np.searchsorted(what, b) : np.searchsorted(what, b, "right")]
                for r in range(lo, hi, PART):
                    at = order[r : min(r + PART, hi)]
                    for c in range(0, len(q), 512):
                        qs = q[c : c + 512]
                        rough = (y[qs] / ny[qs, None]) @ (x[at] / nx[at, None]).T
                        rough[qrow[qs][:, None] == lrow[at]] = -9
                        if len(at) > k:
                            edge = -np.partition(-rough, k - 1, axis=1)[:, k - 1 : k]
                        else:
                            edge = np.full((len(qs), 1), -2.0)
                        i, j = np.nonzero((rough >= edge - 1e-9) & (rough > -5))
                        exact = (y[qs[i]] * x[at[j]]).sum(axis=1) / (ny[qs[i]] * nx[at[j]])
                        got = (qrow[qs[i]], lrow[at[j]], ids[at[j]], exact)
                        top = best(*got)
                        gathered.append(tuple(g[top] for g in got))
                        size += len(top)
                if size > 500_000:
                    held, size = settle(), 0
                    gathered.clear()
            held = settle() if gathered else held
        query = np.array([names[r] for r in held[0].tolist()], np.int64)
        return pa.table([pa.array(h) for h in (query, *held)], names=["query_id", "query", "row", "vec_id", "score"])

    told = "query_id long, query long, row long, vec_id long, score double"

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("query_id", "query", "row", "vec_id").agg(F.max("score").alias("score"))

    # a list of at most k per shard and query; the k best of these
    lists = checkpointed(merged(placed.groupBy("shard").cogroup(visits.groupBy("shard")).applyInArrow(compare, told)))
    enough = lists.groupBy(F.col("query").alias("row")).count().where(F.col("count") >= min(k, n - 1))
    short = checkpointed(queries.join(enough, "row", "left_anti").select("row", "id", "v"))
    if m := short.count():
        # with all vectors: every block of vectors meets every block of these queries
        over, by = (-(-c * dim * 8 // BLOCK_BYTES) for c in (n, m))
        each = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
        dealt = lambda c: F.pmod(F.xxhash64("row"), F.lit(c))
        one = F.lit(0).cast("long")
        left = source.withColumn("q", each(by)).select((dealt(over) * by + F.col("q")).cast("int").alias("shard"), one.alias("bucket"), "row", "id", "v")
        right = short.withColumn("p", each(over)).select((F.col("p") * by + dealt(by)).cast("int").alias("shard"), "row", "id", F.array(one).alias("buckets"), "v")
        lists = merged(lists.unionByName(left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(compare, told)))
    ordered = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "row"))), 1, k)
    out = lists.groupBy("query_id", "query").agg(ordered.alias("near")).select("query_id", F.posexplode("near").alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.s")).alias("score"))


def _groups(x: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return cut.tolist(), np.append(cut[1:], len(x)).tolist() if len(x) else []


def brute_force(vectors: list[tuple[int | None, list[float] | None]], queries: set[int], k: int = 5) -> list[tuple]:
    """(query_id, rank, vec_id, score) by comparing all rows of one length, with exact sums."""
    ok = [(i, [float(c) for c in v]) for i, v in vectors if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []

    def cosine(a: list[float], b: list[float]) -> float:
        a, b = ([c / 2 ** math.frexp(max(map(abs, x)))[1] for c in x] for x in (a, b))
        dot = lambda x, y: math.fsum(p * q for p, q in zip(x, y, strict=True))
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))

    for n, (q, a) in enumerate(ok):
        if q in queries:
            near = sorted(((-cosine(a, b), i) for m, (i, b) in enumerate(ok) if m != n and len(a) == len(b)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out
