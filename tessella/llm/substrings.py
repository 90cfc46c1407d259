"""Substring deduplication over a de Bruijn graph of token k-mers, exact, verified at source coordinates.

Every SPAN consecutive words are an edge of the graph, from their first SPAN - 1 words to their last. As in parallel
compaction of genome graphs, edges are bucketed by minimizer, the smallest hash of their K-word runs: a run of
successive edges with one minimizer occurrence is a super-edge, about one for twelve words, and only super-edges are
shuffled. Equal edges have equal minimizers at equal offsets, so they always meet in one bucket.

1. Per minimizer: how many super-edges, and whether all read alike. Single ones are unique paths and drop out.
2. Where all read alike, each is a repeated nonbranching path as a whole.
3. Where a bucket holds different readings the path branches. One source coordinate per distinct reading is looked up
   in the texts, its edges are hashed one by one, and an edge that two readings share is repeated; so are all edges of
   a reading that occurs twice. (Within one reading no edge occurs twice: the minimizer's offset differs.)
4. Repeated readings are compacted over their ends: where every occurrence of one is followed by the same other, and every
   occurrence of that is preceded by it, joins link them, and linked occurrences are one path of their text.
5. Paths go back to their source coordinates. The words there are digested, 128 bits a path, and paths whose hashes agree
   but whose words do not are no repetitions: they stay, unless others have the same words. What is left is removed.

Hot buckets are counted with partial aggregates and joined with plain equi-joins, which Spark splits by skew. Buckets and
readings are found by 64-bit hashes; what is removed was compared by its words. Null text has no words. Rows that repeat
id and text are documents of their own and so repeat each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, Words, batch, bloom_of, discard, doc_key, free, in_bloom, materialise, mix, signed, sliding_min, span_hash, words_of

SPAN, K = 35, 12
_LOW = np.uint64((1 << 24) - 1)

SUPER = "k1 long, k2 long, m long, c long, s int, n int"
_SUPER = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("m", pa.int64()), ("c", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])


def super_edges(w: Words, span: int = SPAN, k: int = K) -> dict[str, np.ndarray]:
    """row, minimizer m, content c, first edge s (word index in the row) and number of edges n of each super-edge."""
    none = {x: np.zeros(0, np.int64) for x in ("row", "m", "c", "s", "n", "at")}
    at, h = w.grams(k)
    width = span - k + 1
    if len(at) < width:
        return none
    packed = (h & ~_LOW) | (np.arange(len(h), dtype=np.uint64) & _LOW)  # leftmost of equals
    low = sliding_min(packed, width)
    first = np.flatnonzero(w.row[at[: len(low)]] == w.row[at[width - 1 :]])
    if not len(first):
        return none
    pick = first + ((low[first] & _LOW).astype(np.int64) - first) % (1 << 24)
    edge = at[first]  # word index of each edge
    new = np.ones(len(first), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (edge[1:] != edge[:-1] + 1)
    lead = np.flatnonzero(new)
    n = np.diff(np.append(lead, len(first)))
    s, p = edge[lead], at[pick[lead]]
    content = span_hash(w.hash, s, s + n + span - 1) + (p - s).astype(np.uint64)
    row = w.row[s]
    return {"row": row, "m": signed(mix(h[pick[lead]])), "c": signed(mix(content)), "s": s - w.first[row], "n": n, "at": s}


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        for lo, _, w in words_of(b.column(2), SPACED):
            e = super_edges(w)
            yield batch(_SUPER, k1=k1[lo + e["row"]], k2=k2[lo + e["row"]], m=e["m"], c=e["c"], s=e["s"], n=e["n"])


EDGES = "c long, edge long, j int"
_EDGES = pa.schema([("c", pa.int64()), ("edge", pa.int64()), ("j", pa.int32())])


def _read_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges, one by one, of the readings looked up in each text."""
    for b in batches:
        wanted = b.column(1).to_pylist()
        for lo, hi, w in words_of(b.column(0), SPACED):
            c, at, j = [], [], []
            for r in range(lo, hi):
                for x in wanted[r]:
                    span = np.arange(x["n"])
                    c.append(np.full(x["n"], x["c"]))
                    at.append(w.first[r - lo] + x["s"] + span)
                    j.append(span)
            if c:
                at = np.concatenate(at)
                yield batch(_EDGES, c=np.concatenate(c), edge=signed(span_hash(w.hash, at, at + SPAN)), j=np.concatenate(j))


def _only(bloom):
    """Of (k1, k2, text) the rows whose k2 may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bloom(bloom.value, b.column(1).to_numpy())))

    return run


DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


SEEN = "seen array<struct<lo:int,hi:int,g:long,d:binary>>"
_SEEN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("g", pa.int64()), ("d", pa.binary())]))
_REMOVED = pa.schema([*_OUT, ("k1", pa.int64()), ("k2", pa.int64()), ("seen", _SEEN)])


def covered(n: int, runs: list[dict] | None) -> np.ndarray:
    """Which of n words the edges of the runs cover."""
    step = np.zeros(n + 1, np.int64)
    for x in runs or ():
        step[x["lo"]] += 1
        step[min(n, x["hi"] + SPAN - 1)] -= 1
    return np.cumsum(step[:-1]) > 0


def kept_text(w: Words, r: int, runs: list[dict] | None) -> tuple[int, int, bytes]:
    """(words, removed words, the kept words joined by one space) of row r."""
    n, first = int(w.count[r]), int(w.first[r])
    gone = covered(n, runs)
    if not n:
        return 0, 0, b""
    start, end = w.start[first : first + n][~gone], w.end[first : first + n][~gone]
    if not len(start):
        return n, n, b""
    size = end - start + 1  # each word and the space after it
    stop = np.cumsum(size)
    src = np.repeat(start - (stop - size), size) + np.arange(stop[-1])
    out = w.raw[np.minimum(src, len(w.raw) - 1)]
    out[stop - 1] = 32
    return n, int(gone.sum()), out[:-1].tobytes()


def spaced(w: Words, r: int) -> tuple[bytes, np.ndarray]:
    """The words of row r joined by one space, and where each begins there (with the end of all)."""
    _, _, whole = kept_text(w, r, None)
    first, n = int(w.first[r]), int(w.count[r])
    return whole, np.concatenate([[0], np.cumsum(w.end[first : first + n] - w.start[first : first + n] + 1)])


def digests(w: Words, r: int, runs: list[dict]) -> list[dict]:
    """The runs with a digest of the words that their edges cover."""
    whole, at = spaced(w, r)
    return [x | {"d": hashlib.blake2b(whole[at[x["lo"]] : at[min(len(at) - 1, x["hi"] + SPAN - 1)] - 1], digest_size=16).digest()} for x in runs]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs = b.column(4).to_pylist()
        for lo, hi, w in words_of(b.column(3), SPACED):
            got = [kept_text(w, r, runs[lo + r]) for r in range(hi - lo)]
            seen = [digests(w, r, runs[lo + r]) if runs[lo + r] else None for r in range(hi - lo)]
            mine = {k: b.column(i).slice(lo, hi - lo) for i, k in enumerate(("k1", "k2", "doc_id"))}
            yield batch(_REMOVED, **mine, n_words=[g[0] for g in got], n_removed=[g[1] for g in got], kept_sha256=[hashlib.sha256(g[2]).hexdigest() for g in got], seen=seen)


def compacted(found: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi, g): nonbranching paths of ``found`` (k1, k2, c, s, n), the occurrences of repeated readings.

    Paths of one g have the same readings in the same order. Windows run over one text.
    """
    c, text = F.col, Window.partitionBy("k1", "k2").orderBy("s")
    beside = lambda f, name: f(name).over(text)
    after = F.when(beside(F.lead, "s") == c("s") + c("n"), beside(F.lead, "c")).alias("after")
    before = F.when(beside(F.lag, "s") + beside(F.lag, "n") == c("s"), beside(F.lag, "c")).alias("before")
    step = materialise(found.select("k1", "k2", "c", "s", "n", after, before), "steps")
    ends = step.groupBy("c").agg(F.count("*").alias("all"), *(f(x).alias(f"{x}_{f.__name__}") for x in ("after", "before") for f in (F.min, F.max, F.count)))
    only = lambda x: ends.where((c(f"{x}_count") == c("all")) & (c(f"{x}_min") == c(f"{x}_max"))).select("c", c(f"{x}_min").alias(x))
    links = materialise(only("after").join(only("before").select(c("c").alias("after"), c("before").alias("c_")), "after").where("c = c_ and c <> after").select(c("c").alias("before"), c("after").alias("c"), F.lit(True).alias("linked")), "links")
    glued = step.join(links, ["before", "c"], "left").withColumn("path", F.sum(F.when(c("linked"), 0).otherwise(1)).over(text))
    out = glued.groupBy("k1", "k2", "path").agg(F.min("s").alias("lo"), F.max(c("s") + c("n")).alias("hi"), F.xxhash64(F.min(F.struct("s", "c"))["c"], F.count("*")).alias("g"))
    out = materialise(out.select("k1", "k2", "lo", "hi", "g"), "paths")
    discard(step, links)
    return out


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(k1, k2, runs): for each document key, first and end (exclusive) of its runs of repeated edges, and the group g of
    those that should read alike."""
    keyed = doc_key(docs)
    supers = materialise(keyed.mapInArrow(_emit, SUPER), "super-edges")
    # written tables meet in joins whose two sides are dealt out anew: those Spark can split where a key is hot
    buckets = materialise(supers.groupBy("m").agg(F.count("*").alias("copies"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("copies > 1").select("m", (F.col("lo") != F.col("hi")).alias("branches")), "buckets")
    met = materialise(supers.join(buckets, "m").select("k1", "k2", "c", "s", "n", "branches"), "repeated")
    discard(supers)
    branching = met.where("branches")
    readings = materialise(branching.groupBy("c").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "s", "n")).alias("x")), "readings")
    wanted = materialise(readings.select("x.k1", "x.k2", F.struct("c", "x.s", "x.n").alias("y")).groupBy("k1", "k2").agg(F.collect_list("y").alias("wanted")), "wanted")  # within one text
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted.select("k2")))
    edges = materialise(keyed.mapInArrow(_only(bloom), "k1 long, k2 long, text string").join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(_read_edges, EDGES), "edges")
    bloom.destroy()
    shared = materialise(edges.groupBy("edge").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("edge"), "shared")
    again = edges.join(shared, "edge").groupBy("c").agg(F.array_sort(F.collect_set(F.struct("j", "edge"))).alias("js"))  # at most SPAN
    free(docs.sparkSession)
    found = materialise(readings.select("c", "copies", "x").join(again, "c", "left").where("copies > 1 or js is not null"), "found")
    again = branching.join(found.select("c", "copies", "js"), "c")
    whole = met.where("not branches").select("k1", "k2", "c", "s", "n").unionByName(again.where("copies > 1").select("k1", "k2", "c", "s", "n"))
    single = again.where("copies = 1").select("k1", "k2", "s", F.explode("js").alias("x")).select("k1", "k2", (F.col("s") + F.col("x.j")).alias("lo"), (F.col("s") + F.col("x.j") + 1).alias("hi"), F.col("x.edge").alias("g"))
    # an edge of a single reading is held against one coordinate of each other reading that has it
    other = found.where("copies > 1").select("x.k1", "x.k2", "x.s", F.explode("js").alias("y"))
    single = single.unionByName(other.select("k1", "k2", (F.col("s") + F.col("y.j")).alias("lo"), (F.col("s") + F.col("y.j") + 1).alias("hi"), F.col("y.edge").alias("g")))
    paths = compacted(whole)
    runs = paths.unionByName(single).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "g"))).alias("runs"))  # within one text
    out = materialise(runs, "runs")
    discard(buckets, met, readings, wanted, edges, shared, found, paths)
    return out


def removed(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(k1, k2, .., seen), written: every document without the words of its runs, and what the runs read."""
    parts = doc_key(docs, "doc_id").join(runs, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "runs")
    return materialise(parts.mapInArrow(_remove, f"{DDL}, k1 long, k2 long, {SEEN}"), "removed")


def verified(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): documents without those of ``runs`` whose words another run of the group has."""
    out = removed(docs, runs)
    read = out.where("seen is not null").select("k1", "k2", F.explode("seen").alias("x")).select("k1", "k2", "x.*")
    if not read.groupBy("g").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b").isEmpty():
        # hashes agree where words do not: only runs whose words occur again count
        true = read.groupBy("g", "d").count().where("count > 1").select("g", "d")
        again = materialise(read.join(true, ["g", "d"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("lo", "hi", "g"))).alias("runs")), "runs")
        old, out = out, removed(docs, again)
        discard(old, again)
    return out.select(*(f.split()[0] for f in DDL.split(", ")))


def remove(docs: DataFrame) -> DataFrame:
    """One row per document: its words, how many of them repeated spans cover, and the digest of the words that stay."""
    runs = repeated_runs(docs)
    out = verified(docs, runs)
    discard(runs)
    return out


def op7_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
