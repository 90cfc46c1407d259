"""N-gram Jaccard join with set relations: the components of all exact links of distinct shingle sets.

A document's set is its distinct shingles of a ``Law``'s number of words, 4 unless another is given. Documents of equal
sets form a class and are joined once. Of each set, in a global order from rare to frequent, the prefix that any partner
must meet is indexed. The order rests on a sketch of all shingles' counts, of fixed size: a poor estimate costs time,
never a link. Members whose index lists hold the same sets are one list, in which a set stands at the first of its
positions: a passage that only two sets share gives one list, not one for each shingle.

Index lists are skipped by position. A pair is formed where its first common member stands: at position i of a set of n,
at most n - i members can be common. That bounds the partner's size from above on either side, so each entry, by its
size and position, is dealt to the blocks (list, size block of the larger set, size block of the smaller set) that it
can still reach, and a pair meets in the one block that both have opened.

Answers are derived from those of similar sets, twice.

* In each of at most ROUNDS rounds a set is compared with HEADS others only, the heads of the lists that it shares most
  of. A verified link gives it the head's component; pairs within a component are never formed again. The rounds end
  early when one links nothing. What is left then, pairs of one list in different components, is compared in full, so
  that the number of rounds decides on time and not on results.
* The distance (size of the symmetric difference) to the first head, exact where it was compared and bounded by bitmaps
  else, is kept. Sets of one head whose distances to it are further apart than a link allows are not formed as a pair:
  the head's answers refute them by the triangle inequality.

Pairs also pass parity bitmaps (their Hamming distance bounds the symmetric difference from below) before sets are
fetched and compared. Components are found by minimum labels and pointer jumping over written tables, each deleted when
its successor stands. Links are not returned, since pairs within a component are not formed.

Null text, or text without words, has an empty set: n_shingles 0 and a component of its own. Fewer words than a shingle
has are one shingle. Rows that repeat an id are documents each; a null id gives a class no name, and a component of such
rows only has a null one. An empty table gives an empty result. Sets and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, Words, batch, bloom_of, discard, doc_key, free, in_bloom, materialise, mix, signed, span_hash, words_of

ROUNDS, HEADS, SEATS = 3, 4, 4
QUICK = 16  # longs of the bitmap that a join's condition compares
SKETCH = 1 << 20  # counters
BLOCK = 1 << 16


@dataclass(frozen=True)
class Law:
    """Sets of distinct shingles of ``words`` words are linked from a Jaccard similarity of ``num / den``."""

    words: int = 4
    num: int = 85
    den: int = 100

    def at_least(self, total: int | np.ndarray) -> int | np.ndarray:
        """The smallest intersection of sets of ``total`` members together that links them."""
        return (self.num * total + self.num + self.den - 1) // (self.num + self.den)

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """How many of a set's members, from rare to frequent, any partner must meet."""
        return size - (self.num * size + self.den - 1) // self.den + 1

    def need(self, total: Column) -> Column:
        """``at_least`` of a column."""
        return F.floor((total.cast("long") * self.num + self.num + self.den - 1) / (self.num + self.den))

    def smallest(self, n: Column) -> Column:
        """The size of a set's smallest possible partner."""
        return F.ceil(n.cast("long") * self.num / self.den)

    def reach(self, n: Column, pos: Column) -> Column:
        """The size of the largest partner that allows a link whose first common member stands at ``pos``."""
        return F.floor((n - pos).cast("long") * (self.num + self.den) / self.num) - n

    def block(self, n: Column, fine: int = 1) -> Column:
        """Partners' sizes differ by at most a factor den / num, so their blocks by at most ``fine``."""
        return F.floor(F.log(n.cast("double")) * fine / math.log(self.den / self.num) + 1e-9).cast("int")

    def can_link(self, n: Column, m: Column) -> Column:
        return (F.least(n, m).cast("long") * self.den) >= (F.greatest(n, m).cast("long") * self.num)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, by row and hash."""
    at, h = w.grams(n)
    row = w.row[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    row = np.concatenate([row, short])
    h = np.concatenate([h, span_hash(w.hash, w.first[short], w.first[short + 1])])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def bitmap_bits(n: int) -> int:
    return min(4096, max(64, 1 << math.ceil(math.log2(max(n, 1)))))


def bitmap(h: np.ndarray) -> bytes:
    """Parity of the set's members in each of 64 to 4096 cells; the larger folds onto the smaller by xor of halves."""
    bits = bitmap_bits(len(h))
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def quick(row: np.ndarray, h: np.ndarray, rows: int) -> list[np.ndarray]:
    """The parity of 64 * QUICK cells of each row as longs, which a join's condition can compare."""
    cells = 64 * QUICK
    odd = np.bincount(row * cells + ((h >> np.uint64(16)) & np.uint64(cells - 1)).astype(np.int64), minlength=rows * cells) & 1
    return list(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(rows, QUICK))


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    m, n = len(a) * 8, len(b) * 8
    while m > n:
        m //= 2
        x = (x >> m) ^ (x & ((1 << m) - 1))
    while n > m:
        n //= 2
        y = (y >> n) ^ (y & ((1 << n) - 1))
    return (x ^ y).bit_count()


SETS = "doc_id long, k1 long, k2 long, n int, cls long, bits binary, quick array<long>, block int, counts binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("bits", pa.binary()), ("quick", pa.list_(pa.int64())), ("block", pa.int32()), ("counts", pa.binary())])


def _classes(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of each row's set, whatever the order of its members; 0 for none."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    return np.where(np.diff(first) > 0, signed(mix(total[first[1:]] - total[first[:-1]])), 0)


def _describe(law: Law):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for b in batches:
            for lo, hi, w in words_of(b.column(3), SPACED, lower=True):
                row, h = shingles(w, law.words)
                counts += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                n = np.diff(first)
                none = [None] * (hi - lo)
                yield batch(_SETS, doc_id=b.column(2).slice(lo, hi - lo), k1=b.column(0).slice(lo, hi - lo), k2=b.column(1).slice(lo, hi - lo), n=n, cls=_classes(first, h), bits=[bitmap(h[first[r] : first[r + 1]]) if n[r] else None for r in range(hi - lo)], quick=quick(row, h, hi - lo), block=none, counts=none)
        for i in range(SKETCH // BLOCK):
            part = counts[i * BLOCK : (i + 1) * BLOCK]
            if part.any():
                yield batch(_SETS, doc_id=[None], k1=[None], k2=[None], n=[None], cls=[None], bits=[None], quick=[None], block=[i], counts=[zlib.compress(part.astype("<i8").tobytes(), 1)])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in pdf["counts"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [zlib.compress(total.astype("<i8").tobytes(), 1)]})


def frequency_levels(described: DataFrame) -> np.ndarray:
    """A byte per counter: four times the binary logarithm of its count. Summed in two steps on the executors; the
    sum is of fixed size."""
    parts = described.where("block is not null").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    once = parts.groupBy("block", "salt").applyInPandas(_add, "block int, counts binary")
    out = np.zeros(SKETCH, np.int64)
    for r in once.groupBy("block").applyInPandas(_add, "block int, counts binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return np.minimum(np.round(4 * np.log2(out + 1)), 255).astype(np.uint8)


ENTRIES = "token long, cls long, n int, pos int"
_ENTRIES = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _index(levels, law: Law):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in words_of(b.column(0), SPACED, lower=True):
                row, h = shingles(w, law.words)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                cls, n = _classes(first, h), np.diff(first)
                order = np.lexsort((h, levels.value[(h >> np.uint64(44)).astype(np.int64)], row))
                row, h = row[order], h[order]
                pos = np.arange(len(h)) - first[row]
                size = n[row]
                keep = pos < law.prefix(size)
                yield batch(_ENTRIES, token=signed(h[keep]), cls=cls[row[keep]], n=size[keep], pos=pos[keep])

    return run


_NEAR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("first", pa.bool_()), ("apart", pa.int32()), ("near", pa.bool_())])


def _near(law: Law):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How far apart pairs are at least, by their bitmaps, and whether that allows a link."""
        for b in batches:
            na, nb = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64)
            least = np.fromiter((apart(x, y) for x, y in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)), np.int64, b.num_rows)
            yield batch(_NEAR, a=b.column(0), b=b.column(1), na=b.column(2), nb=b.column(3), first=b.column(4), apart=least, near=least <= na + nb - 2 * law.at_least(na + nb))

    return run


MEMBERS = "k1 long, k2 long, members binary"
_MEMBERS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("members", pa.binary())])


def _fetch(bloom, law: Law):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_bloom(bloom.value, b.column(1).to_numpy())))
            for lo, hi, w in words_of(b.column(2), SPACED, lower=True) if b.num_rows else ():
                row, h = shingles(w, law.words)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                yield batch(_MEMBERS, k1=b.column(0).slice(lo, hi - lo), k2=b.column(1).slice(lo, hi - lo), members=[h[first[r] : first[r + 1]].tobytes() for r in range(hi - lo)])

    return run


_COMPARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.bool_()), ("differ", pa.int32()), ("linked", pa.bool_())])


def _compare(law: Law):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ, linked = [], []
            for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(q, p)
                common, total = int((q[np.minimum(at, len(q) - 1)] == p).sum()), len(p) + len(q)
                differ.append(total - 2 * common)
                linked.append(common >= law.at_least(total))
            yield batch(_COMPARED, a=b.column(0), b=b.column(1), first=b.column(2), differ=differ, linked=linked)

    return run


def compared(docs: DataFrame, classes: DataFrame, pairs: DataFrame, law: Law) -> tuple[DataFrame, DataFrame]:
    """Of ``pairs`` (a, b, na, nb, first), classes: the exact (differ, linked) of those that bitmaps allow, and all with
    their lower bound ``apart``. Both are written tables."""
    of = lambda x: classes.select(F.col("cls").alias(x), F.col("bits").alias(f"{x}_bits"))
    bounded = materialise(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "first", "a_bits", "b_bits").mapInArrow(_near(law), "a long, b long, na int, nb int, first boolean, apart int, near boolean"), "near")
    near = bounded.where("near")
    need = materialise(near.select(F.col("a").alias("cls")).union(near.select("b")).distinct().join(classes.select("cls", "src.k1", "src.k2"), "cls"), "need")
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(need.select("k2")))
    members = materialise(doc_key(docs).mapInArrow(_fetch(bloom, law), MEMBERS).join(need, ["k1", "k2"]).groupBy("cls").agg(F.first("members").alias("members")), "members")
    got = lambda x: members.select(F.col("cls").alias(x), F.col("members").alias(f"{x}_members"))
    out = materialise(near.join(got("a"), "a").join(got("b"), "b").select("a", "b", "first", "a_members", "b_members").mapInArrow(_compare(law), "a long, b long, first boolean, differ int, linked boolean"), "compared")
    discard(need, members)
    bloom.destroy()
    free(docs.sparkSession)
    return out, bounded


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex that each vertex of the edges (a, b) reaches; minimum labels and pointer jumping."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    step = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumn("moved", F.lit(True)), "step")
    while not step.where("moved").isEmpty():
        labels = step.select("v", "comp")
        of = labels.select(F.col("v").alias("b"), F.col("comp").alias("theirs"))
        best = both.join(of, "b").groupBy(F.col("a").alias("v")).agg(F.min("theirs").alias("best"))
        lower = labels.join(best, "v").select("v", "comp", F.least("comp", "best").alias("low"))
        # the label of the own label, and what was found for it
        at = lower.select(F.col("v").alias("low"), F.col("low").alias("jump"))
        now = F.least("low", F.coalesce("jump", "low"))
        before, step = step, materialise(lower.join(at, "low", "left").select("v", now.alias("comp"), (now < F.col("comp")).alias("moved")), "step")
        discard(before)
    discard(both)
    return step


def undecided(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """(list, cls, n, pos, w, comp) of the lists that still hold sets of several components."""
    known = entries.join(labels, "cls").select("list", "cls", "n", "pos", "w", "comp")
    mixed = known.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
    return known.join(mixed, "list")


def candidates(entries: DataFrame, turn: int, law: Law) -> DataFrame:
    """(a, b, na, nb, first): for each set up to HEADS heads, of other components, of most of its lists; the first of
    them is marked. At first the smallest set of a list is its head; in later turns a list has SEATS heads, by hash."""
    c = F.col
    entries = entries.withColumn("block", law.block(c("n")))
    order = [F.lit(0).cast("long")] if turn == 0 else [F.xxhash64("cls", F.pmod("list", F.lit(8)), F.lit(turn * SEATS + s)) for s in range(SEATS)]
    seats = [F.min(F.struct(o.alias("o"), c("cls").alias("cls"), c("n").alias("n"), c("comp").alias("comp"))).alias(f"seat{i}") for i, o in enumerate(order)]
    heads = entries.groupBy("list", "block").agg(*seats, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    heads = heads.select("list", "block", F.explode(F.array_distinct(F.array(*(F.struct(f"seat{i}.cls", f"seat{i}.n", f"seat{i}.comp") for i in range(len(order)))))).alias("head"))
    votes = entries.join(heads, ["list", "block"]).where((c("comp") != c("head.comp")) & law.can_link(c("n"), c("head.n")))
    votes = votes.groupBy(c("cls").alias("b"), c("n").alias("nb"), c("head.cls").alias("a"), c("head.n").alias("na")).agg(F.sum("w").alias("votes"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("votes"), "a"))
    return votes.withColumn("i", rank).where(F.col("i") <= HEADS).select("a", "b", "na", "nb", (F.col("i") == 1).alias("first"))


def answers_of(verified: DataFrame, bounded: DataFrame) -> DataFrame:
    """(cls, head, near, far): how far each set is from its first head at least and at most; the head is its own."""
    c = F.col
    own = bounded.where("first").select("a", "b", "na", "nb", "apart").join(verified.where("first").select("a", "b", "differ"), ["a", "b"], "left")
    asked = own.select(c("b").alias("cls"), c("a").alias("head"), F.coalesce("differ", "apart").alias("near"), F.coalesce(c("differ"), c("na") + c("nb")).alias("far"))
    zero = F.lit(0)
    both = asked.select("*", F.lit(1).alias("of")).union(bounded.select("a", "a", zero, zero, zero).distinct())
    best = F.min(F.struct("of", "head", "near", "far")).alias("x")  # a set that is a head itself answers for itself
    return both.groupBy("cls").agg(best).select("cls", "x.head", "x.near", "x.far")


def remaining(entries: DataFrame, classes: DataFrame, answers: DataFrame, law: Law) -> DataFrame:
    """(a, b, na, nb, first): all pairs of one list in different components that sizes, positions, answers of a common
    head and a bitmap allow. They meet in the blocks that both can reach from where they stand."""
    c = F.col
    quick = [f"q{i}" for i in range(QUICK)]
    entries = entries.join(classes.select("cls", *(F.get("quick", i).alias(q) for i, q in enumerate(quick))), "cls").join(answers, "cls", "left")
    keep = ("cls", "n", "pos", "comp", "head", "near", "far", *quick)
    n, reach, lowest = c("n"), law.reach(c("n"), c("pos")), law.smallest(c("n"))
    side = lambda x: [c(k).alias(f"{x}_{k}") for k in keep]
    small = entries.where(reach >= n).select("list", F.explode(F.sequence(law.block(n, 2), law.block(reach, 2))).alias("big"), law.block(n, 2).alias("little"), *side("x"))
    large = entries.where(reach >= lowest).select("list", law.block(n, 2).alias("big"), F.explode(F.sequence(law.block(lowest, 2), law.block(F.least(n, reach), 2))).alias("little"), *side("y"))
    total = c("x_n") + c("y_n")
    need = law.need(total)
    most = total - 2 * need
    met = large.join(small, ["list", "big", "little"]).where((c("x_comp") != c("y_comp")) & ((c("x_n") < c("y_n")) | ((c("x_n") == c("y_n")) & (c("x_cls") < c("y_cls")))))
    met = met.where(law.can_link(c("x_n"), c("y_n")) & (F.least(c("x_n") - c("x_pos"), c("y_n") - c("y_pos")) >= need))
    refuted = (c("x_head") == c("y_head")) & ((c("x_near") - c("y_far") > most) | (c("y_near") - c("x_far") > most))
    met = met.where(~F.coalesce(refuted, F.lit(False)))
    met = met.where(sum((F.bit_count(c(f"x_{q}").bitwiseXOR(c(f"y_{q}"))) for q in quick[1:]), start=F.bit_count(c("x_q0").bitwiseXOR(c("y_q0")))) <= most)
    return met.select(c("x_cls").alias("a"), c("y_cls").alias("b"), c("x_n").alias("na"), c("y_n").alias("nb"), F.lit(False).alias("first")).distinct()


def joined_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(cls, comp), written, after the links (a, b) of sets have joined their components."""
    of = lambda x: labels.select(F.col("cls").alias(x), F.col("comp").alias(f"{x}_comp"))
    between = edges.join(of("a"), "a").join(of("b"), "b").where("a_comp <> b_comp").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct()
    found = components(between)
    up = found.select(F.col("v").alias("comp"), F.col("comp").alias("low"))
    out = materialise(labels.join(up, "comp", "left").select("cls", F.coalesce("low", "comp").alias("comp")), "labels")
    discard(found)
    return out


def index_lists(docs: DataFrame, described: DataFrame, law: Law) -> DataFrame:
    """(list, cls, n, pos, w): the lists that hold several sets, those of the same sets as one; w counts them."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(described))
    entries = materialise(docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_index(levels, law), ENTRIES), "entries")
    h = F.xxhash64("cls")
    # copies of a set add the same to each of its lists; sums of 24 bits each do not overflow. Lists that agree by chance would
    # only give more pairs to compare
    parts = [F.sum(F.shiftrightunsigned(h, by).bitwiseAND(F.lit((1 << 24) - 1))).alias(f"s{by}") for by in (0, 24)]
    # a written table meets the entries in a join whose two sides are dealt out anew, which Spark can split at hot tokens
    lists = materialise(entries.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), *parts).where("lo <> hi").select("token", F.xxhash64("lo", "hi", "s0", "s24").alias("list")), "lists")
    shared = materialise(entries.join(lists, "token").groupBy("list", "cls").agg(F.first("n").alias("n"), F.min("pos").alias("pos"), F.count("*").alias("w")), "shared")
    discard(entries, lists)
    levels.destroy()
    return shared


def linked_classes(docs: DataFrame, described: DataFrame, classes: DataFrame, law: Law) -> DataFrame:
    """(cls, comp), written, of every class that shares a list with another."""
    shared = index_lists(docs, described, law)
    free(docs.sparkSession)
    labels = materialise(shared.select("cls", F.col("cls").alias("comp")).distinct(), "labels")
    answers, left = None, materialise(shared.withColumn("comp", F.col("cls")), "undecided")
    for turn in range(ROUNDS):
        verified, bounded = compared(docs, classes, candidates(left, turn, law), law)
        if answers is None:
            answers = materialise(answers_of(verified, bounded), "answers")
        new = verified.where("linked")
        done = new.isEmpty()
        if not done:
            old, labels = (labels, left), joined_labels(labels, new)
            left = materialise(undecided(left.drop("comp"), labels), "undecided")
            discard(*old)
        discard(verified, bounded)
        free(docs.sparkSession)
        if done:
            break
    pairs = materialise(remaining(left, classes, answers, law), "pairs")
    verified, bounded = compared(docs, classes, pairs, law)
    out = joined_labels(labels, verified.where("linked"))
    discard(shared, labels, left, answers, pairs, verified, bounded)
    return out


def members(docs: DataFrame, law: Law = Law()) -> DataFrame:
    """(k1, k2, doc_id, n_shingles, component_id, stays) of every document, by the key of ``doc_key``.

    Of a component the rows of one key stay: of the smallest id, then of the smallest key; rows without an id come
    last. A document without shingles stays.
    """
    described = materialise(doc_key(docs, "doc_id").select("k1", "k2", "doc_id", "text").mapInArrow(_describe(law), SETS), "sets")
    rows = described.where("block is null")
    classes = materialise(rows.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("quick").alias("quick"), F.min(F.struct("k1", "k2")).alias("src"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "k1", "k2")).alias("least")), "classes")
    free(docs.sparkSession)
    labels = linked_classes(docs, described, classes, law)
    comp = materialise(classes.select("cls", "least").join(labels, "cls", "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp")), "components")
    least = comp.groupBy("comp").agg(F.min("least").alias("least"))
    named = materialise(comp.select("cls", "comp").join(least, "comp").select("cls", F.when(~F.col("least.nameless"), F.col("least.k1")).alias("component_id"), F.col("least.k1").alias("least_1"), F.col("least.k2").alias("least_2")), "named")
    discard(classes, labels, comp)
    some = F.col("n") > 0
    stays = ~some | ((F.col("k1") == F.col("least_1")) & (F.col("k2") == F.col("least_2")))
    return rows.join(named, "cls", "left").select("k1", "k2", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), stays.alias("stays"))


def group(docs: DataFrame, law: Law = Law()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return members(docs, law).select("doc_id", "n_shingles", "component_id")


def op10_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"))
