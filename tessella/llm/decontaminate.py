"""Benchmark decontamination by winnowing.

Of a run of words, the k-grams' hashes are taken, and in every window of W hashes the smallest is kept (leftmost of
equals). K + W - 1 = N: each span of N words holds a whole window, so any N words shared with a benchmark item give
both sides a common fingerprint. Fingerprints meet in a join that Spark broadcasts or shuffles by size; each hit
carries the words around it and is extended in both directions, word by word, to all windows of N equal words.

A benchmark item of fewer than N words is one window as a whole: there, the first K words (all, if fewer) of the item
are its fingerprint, and documents give the plain L-gram hashes at each length L below K that short items have, or, from
K on, every K-gram of the items of that kind.

A Bloom filter of the benchmark's fingerprints, of fixed size, goes to the tasks and drops what cannot meet; it never
drops a true hit. Items with a null id hit as others do and count as one item together, but are not in the list of ids.
Null text has no words; repeated rows are each answered; without benchmark rows nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, batch, doc_key, materialise, mix, signed, sliding_min, words_of

N, K = 10, 5
W = N - K + 1
BLOOM_BITS = 1 << 23  # one MB, whatever the benchmark's size
_LOW = np.uint64((1 << 24) - 1)


def winnow(words: Words, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the fingerprints: the smallest of each w consecutive k-gram hashes of one row."""
    at, h = words.grams(k)
    if len(at) < w:
        return at[:0], h[:0]
    packed = (h & ~_LOW) | (np.arange(len(h), dtype=np.uint64) & _LOW)  # leftmost of equals
    low = sliding_min(packed, w)
    whole = words.row[at[: len(low)]] == words.row[at[w - 1 :]]
    base = np.arange(len(low))[whole]
    pick = np.unique(base + ((low[whole] & _LOW).astype(np.int64) - base) % (1 << 24))
    return at[pick], h[pick]


def bloom_slots(h: np.ndarray) -> np.ndarray:
    return np.stack([(mix(h + np.uint64(i * 0x9E3779B9)) % np.uint64(BLOOM_BITS)).astype(np.int64) for i in range(3)])


ITEMS = "item_id string, hash long, at int, n int, words string, kind int"
_ITEMS = pa.schema([("item_id", pa.string()), ("hash", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("words", pa.string()), ("kind", pa.int32())])


def context(words: Words, i: int, lo: int, hi: int) -> str:
    """Words lo..hi of the row that word i stands in, cut at the row's ends, joined by one space."""
    r = words.row[i]
    a, b = max(lo, words.first[r]), min(hi, words.first[r + 1])
    return " ".join(words.raw[words.start[j] : words.end[j]].tobytes().decode() for j in range(a, b))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_pylist()
        for lo, _, w in words_of(b.column(1), ALNUM, lower=True):
            rows = {f.name: [] for f in _ITEMS}

            def add(r, h, i, n, text, kind, rows=rows, ids=ids, lo=lo, w=w):
                for k, v in zip(rows, (ids[lo + r], int(h), int(i - w.first[r]), n, text, kind), strict=True):
                    rows[k].append(v)

            for i, h in zip(*winnow(w), strict=True):
                add(w.row[i], signed(np.array([h]))[0], i, int(w.count[w.row[i]]), context(w, i, i - N + K, i + N), 0)
            for r in np.flatnonzero((w.count > 0) & (w.count < N)):  # the whole item is one window
                n, i = int(w.count[r]), int(w.first[r])
                k = min(n, K)
                acc = np.zeros(1, np.uint64)
                for j in range(k):
                    acc = acc * np.uint64(0xD6E8FEB86659FD93 | 1) + w.hash[i + j] + np.uint64(1)
                add(r, signed(mix(acc))[0], i, n, context(w, i, i, i + n), k)
            yield batch(_ITEMS, **rows)


FOUND = "doc_id long, k1 long, k2 long, row long, n_words long, hits array<struct<hash:long,at:int,left:int,kind:int,words:string>>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("kind", pa.int32()), ("words", pa.string())])))])


def _find(bloom, short: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bloom.value, np.uint8)

        def passing(at, h):
            ok = np.ones(len(h), bool)
            for s in bloom_slots(h):
                ok &= (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
            return at[ok], h[ok]

        for b in batches:
            for lo, hi, w in words_of(b.column(4), ALNUM, lower=True):
                hits: list[list[dict]] = [[] for _ in range(hi - lo)]
                for kind in (0, *short):
                    for i, h in zip(*passing(*(winnow(w) if kind == 0 else w.grams(kind))), strict=True):
                        r = w.row[i]
                        left = int(min(N - K, i - w.first[r])) if kind == 0 else 0
                        hits[r].append({"hash": int(signed(np.array([h]))[0]), "at": int(i - w.first[r]), "left": left, "kind": kind, "words": context(w, i, i - left, i + N)})
                yield batch(_FOUND, **{k: b.column(i).slice(lo, hi - lo) for i, k in enumerate(("doc_id", "k1", "k2", "row"))}, n_words=w.count, hits=hits)

    return run


SPANS = "doc_id long, k1 long, k2 long, row long, n_words long, item_id string, lo int, hi int"
_SPANS = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])


def extend(mine: list[str], left: int, theirs: list[str], at: int, kind: int, n: int) -> tuple[int, int] | None:
    """Words of ``mine``, from the fingerprint's first word, that windows shared with ``theirs`` cover.

    ``left`` and ``at`` count the words before the fingerprint; both lists reach N - K words to either side at most,
    which is as far as a window that holds the fingerprint can reach.
    """
    if kind:
        return (0, n) if mine[:n] == theirs[:n] and len(theirs) >= n and len(mine) >= n else None
    a = b = 0
    while a < min(left, at) and mine[left - a - 1] == theirs[at - a - 1]:
        a += 1
    while left + b < len(mine) and at + b < len(theirs) and mine[left + b] == theirs[at + b]:
        b += 1
    return (-a, b) if a + b >= N and b >= K else None


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, k1, k2, row, n_words, at, left, kind, words, met, item, i_at, i_n, i_words = (c.to_pylist() for c in b.columns)
        rows = {f.name: [] for f in _SPANS}
        for r in range(b.num_rows):
            lo = hi = None
            if met[r]:
                got = extend(words[r].split(" "), left[r], i_words[r].split(" "), min(N - K, i_at[r]) if not kind[r] else 0, kind[r], i_n[r])
                lo, hi = (at[r] + got[0], at[r] + got[1]) if got else (None, None)
            for k, v in zip(rows, (doc[r], k1[r], k2[r], row[r], n_words[r], item[r] if lo is not None else None, lo, hi), strict=True):
                rows[k].append(v)
        yield batch(_SPANS, **rows)


def spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, row, n_words, item_id, lo, hi): words lo..hi of the document are words of the item. One pass over the texts.

    Every document has at least one row, with null words where nothing is shared; an item may have a null id.
    """
    spark = docs.sparkSession
    items = materialise(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_items, ITEMS), "fingerprints")
    kinds = [r[0] for r in items.where("kind > 0").select("kind").distinct().collect()]  # at most K values
    bloom = spark.sparkContext.broadcast(bloom_of(items))
    found = doc_key(docs, "doc_id").select("doc_id", "k1", "k2", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(_find(bloom, sorted(kinds)), FOUND)
    flat = found.select("doc_id", "k1", "k2", "row", "n_words", F.explode_outer("hits").alias("h")).select("doc_id", "k1", "k2", "row", "n_words", "h.at", "h.left", "h.kind", "h.words", F.coalesce("h.hash", F.lit(-1) - F.col("row")).alias("key"), F.coalesce("h.kind", F.lit(-1)).alias("key_kind"))
    theirs = items.select(F.lit(True).alias("met"), "item_id", F.col("at").alias("i_at"), F.col("n").alias("i_n"), F.col("words").alias("i_words"), F.col("hash").alias("key"), F.col("kind").alias("key_kind"))
    met = flat.join(theirs, ["key", "key_kind"], "left").select("doc_id", "k1", "k2", "row", "n_words", "at", "left", "kind", "words", "met", "item_id", "i_at", "i_n", "i_words")
    return met.mapInArrow(_extend, SPANS)


def bloom_of(items: DataFrame) -> bytes:
    """The filter's bits, OR-ed block by block on the executors; BLOOM_BITS / 8 bytes reach the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            bits[bloom_slots(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).ravel()] = True
        on = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(on >> 3, pa.int32()), pa.array((1 << (on & 7)).astype(np.int32), pa.int32())], names=["byte", "bit"])

    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    got = items.select("hash").mapInArrow(local, "byte int, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out[got["byte"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint8)
    return out.tobytes()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with what of it the benchmark holds."""
    found = spans(docs, benchmark)
    nameless = F.max(F.col("lo").isNotNull() & F.col("item_id").isNull())
    # distinct spans and items of a document: its own words and the benchmark bound both
    per = found.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"), nameless.cast("int").alias("nameless"))
    state = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")), lambda s, x: F.struct((s["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], s["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(x["hi"], s["end"]).alias("end")), lambda s: s["n"])
    return per.select("doc_id", "n_words", state.alias("n_hit"), (F.size("items") + F.col("nameless")).cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op2_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

