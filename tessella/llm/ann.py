"""Approximate nearest neighbours by an adaptive scan of dimensions over probed inverted lists.

Largest inner product becomes smallest distance by one more dimension, sqrt(M^2 - |x|^2) for rows and 0 for queries.
All vectors are turned by one random rotation, after which any leading block of columns is a fair sample of a
distance. Within a list the columns are read block by block: after d of D columns a candidate is given up when the
hypothesis that its distance is within the present 20th best is refuted, partial * D / d > r^2 * (1 + EPS / sqrt(d))^2.
Scores of the survivors are inner products of the original vectors in double precision.

Lists are k-means cells, fitted on at most SAMPLE rows (those of the smallest hashed ids); the same rows say how many
lists must be probed for a recall of TARGET, so that data without clusters is probed widely. Every row is indexed.
Equal vectors are searched once: of each only the K + 1 smallest ids can appear in an answer, which leaves hot vectors
no weight; they are found by counts and cut in three salted steps. Answers are cut at K + 1 distinct ids, of which each has at
most K rows, so that K stay whatever id a query has. Neighbouring lists are scanned together, in bins of
BIN rows; a long list has several bins, and a bin that many queries ask for is sent to several tasks.

Null, zero or non-finite vectors and rows with a null id take no part, nor do vectors of another length than the most
frequent one (of equals, the longest). Rows that repeat an id are candidates each; a query's own id is never among its
neighbours. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, mix

K, EVERY = 20, 20
SAMPLE, LIST, MAX_LISTS, TARGET = 20_000, 256, 4096, 0.97
EPS, BLOCKS = 2.1, (16, 32, 48)
BIN = 16_384  # rows of neighbouring lists, or of a part of a long one, that are scanned together
QUERIES = 8192  # that meet a bin at a time
STEP = 4096  # rows between two looks at the limit
HOT = 64  # copies from which a vector is cut in steps


class Index:
    """Rotation, centroids and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, norm: float, rows: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.norm = norm
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        x = self.rows(sample)
        n = int(np.clip(rows // LIST, 1, min(MAX_LISTS, len(x))))
        self.centroids = x[rng.choice(len(x), n, replace=False)]
        for _ in range(6):
            own = self.near(x, 1)[:, 0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, own, x)
            count = np.bincount(own, minlength=n)
            self.centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.centroids)
        self.probes = self.enough(sample, x)

    def rows(self, v: np.ndarray) -> np.ndarray:
        v = np.asarray(v, np.float64)
        extra = np.sqrt(np.maximum(self.norm**2 - (v * v).sum(1), 0))
        return np.concatenate([v, extra[:, None]], 1) @ self.rotation

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.asarray(v, np.float64), np.zeros((len(v), 1))], 1) @ self.rotation

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        out = []
        for part in np.array_split(x, max(1, len(x) * len(self.centroids) // 4_000_000)):
            d = (self.centroids**2).sum(1) - 2 * part @ self.centroids.T
            top = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
            out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out)

    def enough(self, sample: np.ndarray, x: np.ndarray) -> int:
        """Lists to probe so that TARGET of the sample's true neighbours of up to 200 of its rows are met."""
        q = sample[:: max(1, len(sample) // 200)]
        own = self.near(x, 1)[:, 0]
        order = self.near(self.queries(q), len(self.centroids))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None].repeat(len(order), 0), 1)
        true = np.argsort(-(q @ sample.T), axis=1)[:, : K + 1]
        need = np.sort(np.take_along_axis(place, own[true], 1).ravel())
        return int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1


class Lazy:
    """Some rows of a block, of which only those are copied that are asked for."""

    def __init__(self, block: np.ndarray, at: np.ndarray):
        self.block, self.at, self.shape = block, at, (len(at), block.shape[1])

    def __getitem__(self, live: np.ndarray) -> np.ndarray:
        return self.block[self.at[live]]


def cut(scores: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of rows, best first, those before and at the first of the (K + 1)-th distinct id, at most K of an id; and whether
    there are that many ids. Whichever id is then left out, the K best of the others are among them."""
    order = np.lexsort((found, -scores))
    scores, found = scores[order], found[order]
    ids, first = np.unique(found, return_index=True)
    full = len(ids) > K
    if full:
        end = int(np.sort(first)[K]) + 1
        scores, found = scores[:end], found[:end]
    if len(found) > len(ids[:K + 1]):
        by = np.argsort(found, kind="stable")
        run = found[by]
        place = np.arange(len(run)) - np.searchsorted(run, run)
        keep = np.sort(by[place < K])
        scores, found = scores[keep], found[keep]
    return scores, found, full


def scan(query: np.ndarray, turned: np.ndarray, blocks: list[np.ndarray], ids: np.ndarray, vectors: np.ndarray, best: tuple[np.ndarray, np.ndarray, bool], base: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """``cut`` of ``best`` and of some rows: their rotated column blocks, ids and original
    vectors. ``turned`` is the rotated query; a squared distance is ``base`` less twice a score."""
    scores, found, full = best
    limit = max(base - 2 * float(scores[-1]), 0.0) if full else np.inf
    d, live, partial, at = len(turned), None, 0.0, 0
    for block in blocks:
        stop = at + block.shape[1]
        diff = (block if live is None else block[live]) - turned[at:stop]
        partial = partial + np.einsum("ij,ij->i", diff, diff)
        keep = partial * (d / stop) <= limit * (1 + (EPS / np.sqrt(stop) if stop < d else 1e-9)) ** 2 + 1e-9 * base
        live, partial, at = (np.flatnonzero(keep) if live is None else live[keep]), partial[keep], stop
        if not len(live):
            return best
    score = (vectors[live] * query).sum(1)
    return cut(np.concatenate([scores, score]), np.concatenate([found, ids[live]]))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, a, b) of the rows that take part; (a, b) is the same for equal vectors only."""
    e = F.col("embedding")
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # as exact as they come
    whole = vectors.select("vec_id", e.cast(f"array<{kind}>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    )
    top = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    same = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))  # -0.0
    return whole.where(F.size("embedding") == (top[0]["d"] if top else 0)).select("vec_id", same.alias("embedding")).select("vec_id", "embedding", F.xxhash64("embedding").alias("a"), F.hash("embedding").alias("b"))


def few_copies(rows: DataFrame) -> DataFrame:
    """Of equal vectors those with the K + 1 smallest ids, at most K rows of an id. Rare vectors pass; hot ones are cut
    salt by salt, one row an id."""
    hot = rows.groupBy("a", "b").count().where(F.col("count") > HOT).select("a", "b", F.lit(True).alias("hot"))
    marked = rows.join(hot, ["a", "b"], "left")
    cut = marked.where("hot").groupBy("a", "b", "vec_id").agg(F.first("embedding").alias("embedding"), F.count("*").alias("times"))
    for salts in (64, 8, 1):
        w = Window.partitionBy("a", "b", "salt").orderBy("vec_id")
        cut = cut.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= K + 1).drop("n", "salt")
    cut = cut.withColumn("_", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(K)).cast("int")))).drop("_", "times")
    return marked.where("hot is null").drop("hot").unionByName(cut)


def fit(rows: DataFrame) -> Index | None:
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("m")).first()
    if not stats["n"]:
        return None
    sample = rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(SAMPLE).select("embedding").toPandas()
    return Index(np.stack(sample["embedding"].to_numpy()).astype(np.float64), float(np.sqrt(stats["m"])), stats["n"])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def search(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): K neighbours of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = materialise(valid(vectors), "vectors")
    index = fit(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent, kind = spark.sparkContext.broadcast(index), dict(rows.dtypes)["embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = sent.value.near(sent.value.rows(_matrix(b.column(1))), 1)[:, 0] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *b.columns], names=["list", *b.schema.names])

    placed = materialise(few_copies(rows).select("vec_id", "embedding").mapInArrow(place, f"list int, vec_id long, embedding {kind}"), "lists")
    length = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # at most MAX_LISTS
    parts, first, held, bins = np.ones(len(index.centroids), int), np.zeros(len(index.centroids), int), 0, 0
    for k in range(len(parts)):  # lists share a bin until it is full; a longer one has bins of its own
        n = length.get(k, 0)
        parts[k] = max(1, -(-n // BIN))
        if held + n > BIN and held:
            bins, held = bins + 1, 0
        first[k], held = bins, held + n
        if parts[k] > 1:
            bins, held = bins + int(parts[k]), 0

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and bin, with the lists to scan there, nearest first."""
        for b in batches:
            if b.num_rows:
                at, to, lists = [], [], []
                for i, near in enumerate(sent.value.near(sent.value.queries(_matrix(b.column(2))), sent.value.probes)):
                    by: dict[int, list[int]] = {}
                    for k in near.tolist():
                        for j in range(first[k], first[k] + parts[k]):
                            by.setdefault(j, []).append(k)
                    at += [i] * len(by)
                    to += by.keys()
                    lists += by.values()
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(lists, pa.list_(pa.int32())), *(c.take(pa.array(at)) for c in b.columns)], names=["bin", "lists", "a", "b", "embedding"])

    units = materialise(rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("a", "b").agg(F.first("embedding").alias("embedding")), "queries")
    probes = materialise(units.mapInArrow(probe, f"bin int, lists array<int>, a long, b int, embedding {kind}"), "probes")
    many = materialise(probes.groupBy("bin").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "asked")
    asked = np.zeros(bins + 1 + int(parts.max()), np.int64)  # a number a bin, of BIN rows
    for r in many.collect():
        asked[r["bin"]] = r["parts"]

    def into_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row in its bin, once for every group of queries that meet there."""
        for b in batches:
            k = b.column(0).to_numpy()
            ids = b.column(1).to_numpy()
            own = first[k] + (mix(ids.view(np.uint64)) % parts[k].astype(np.uint64)).astype(int)
            times = asked[own]
            at = np.repeat(np.arange(len(k)), times)
            group = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(own[at], pa.int32()), pa.array(group, pa.int32()), *(c.take(pa.array(at)) for c in b.columns)], names=["bin", "part", "list", "vec_id", "embedding"])

    binned = placed.mapInArrow(into_bins, f"bin int, part int, list int, vec_id long, embedding {kind}")
    sorted_probes = probes.join(many, "bin").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts").cast("long")).cast("int")).drop("parts")

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"a": [], "b": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values(["list", "vec_id"], kind="stable")
            ids, v = left["vec_id"].to_numpy(), np.stack(left["embedding"].to_numpy()).astype(np.float64)
            lists = np.unique(left["list"].to_numpy())
            begin, end = np.searchsorted(left["list"], lists), np.searchsorted(left["list"], lists, "right")
            place = {k: (x, y) for k, x, y in zip(lists.tolist(), begin.tolist(), end.tolist(), strict=True)}
            q = np.stack(right["embedding"].to_numpy()).astype(np.float64)
            turned, whole = sent.value.queries(q), sent.value.rows(v)
            edges = [0, *(x for x in BLOCKS if x < whole.shape[1]), whole.shape[1]]
            blocks = [np.ascontiguousarray(whole[:, x:y]) for x, y in zip(edges, edges[1:], strict=False)]
            for i, (a, b, wanted) in enumerate(zip(right["a"], right["b"], right["lists"], strict=True)):
                best = (np.zeros(0), np.zeros(0, np.int64), False)
                base = float((q[i] * q[i]).sum()) + sent.value.norm**2
                spans = [place[k] for k in wanted if k in place]
                if not spans:
                    continue
                # the nearest list sets a limit, then the others are read in larger steps
                steps = [np.arange(*spans[0])]
                rest = np.concatenate([np.arange(x, y) for x, y in spans[1:]]) if len(spans) > 1 else np.zeros(0, int)
                steps += np.array_split(rest, max(1, -(-len(rest) // STEP)))
                for at in steps:
                    if len(at):
                        best = scan(q[i], turned[i], [x[at] for x in blocks[:1]] + [Lazy(x, at) for x in blocks[1:]], ids[at], Lazy(v, at), best, base)
                out["a"] += [a] * len(best[0])
                out["b"] += [b] * len(best[0])
                out["vec_id"] += best[1].tolist()
                out["score"] += best[0].tolist()
        return pd.DataFrame(out).astype({"a": "int64", "b": "int32", "vec_id": "int64", "score": "float64"})

    found = binned.groupBy("bin", "part").cogroup(sorted_probes.groupBy("bin", "part")).applyInPandas(meet, "a long, b int, vec_id long, score double")
    # the bins' rows are few for a query: they are cut by distinct ids once more where they meet
    best, own = Window.partitionBy("a", "b"), Window.partitionBy("a", "b", "vec_id")
    ranked = found.withColumn("n", F.row_number().over(best.orderBy(F.desc("score"), "vec_id"))).withColumn("again", F.row_number().over(own.orderBy("n")))
    ranked = ranked.where(F.col("again") <= K).withColumn("ids", F.sum((F.col("again") == 1).cast("int")).over(best.orderBy("n")))
    answers = ranked.where(F.col("ids") <= K + 1).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    mine = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "a", "b").distinct()
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, K)
    return mine.join(answers, ["a", "b"]).select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op6_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
