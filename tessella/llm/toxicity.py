"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first four, five and six bytes, so that
inflected forms meet. Filters of widths 1, 2 and 3 run over a text's words; each filter's maximum over the whole text,
rectified, enters a logistic output. Embeddings start from the log-odds of their bucket in the training sample (first
dimension) and noise, and are trained with the filters by Adagrad; gradients reach the words that hold the maxima.

Thresholds are calibrated by language: on labelled rows kept from training the best cut of each language is found and
scores are shifted so that it lies at CUT for all. The language is guessed from the text's function words; no label,
lang, source or doc_id is an input.

Labels are learnt from at most MAX_LABELLED rows, those of the smallest hashed ids, of the folds that are not held out
(crc32 of the id as text, modulo 3, is 1 for held-out rows). Rows whose label is null teach nothing; of repeated
labels one counts. Null and empty texts get a low constant score; repeated rows are scored each; an empty table gives
an empty result. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, batch, mix, pieces, string_parts, words_of

CUT = 0.7
MAX_LABELLED = 4000
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 17, 8, 4, (1, 2, 3)
EPOCHS, RATE, SHARPNESS, PRIOR = 4, 0.05, 1.5, 5.0
# fixed values: function words by which a language is guessed
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as be this by".split(),
    "de": "der die und das ist nicht ein mit auf für von sich den dem zu im".split(),
    "fr": "le la les des et que en un une du dans est pour pas qui sur".split(),
    "es": "el los las que de y en un una con por para del se su lo".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def buckets(w: Words, which: np.ndarray | slice = slice(None)) -> np.ndarray:
    """(words, 4): buckets of words and of their first 4, 5 and 6 bytes."""
    start, size = w.start[which], (w.end - w.start)[which]
    raw = np.append(w.raw, np.zeros(6, np.uint8))
    packed, out = np.zeros(len(size), np.uint64), [w.hash[which]]
    for i in range(6):
        packed |= np.where(i < size, raw[start + i], 0).astype(np.uint64) << np.uint64(8 * i)
        if i >= 3:
            out.append(packed + np.uint64(i << 56))
    return np.stack([(mix(h) % np.uint64(BUCKETS)).astype(np.int32) for h in out], 1)


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), ALNUM, True).hash


_FUNCTION = {k: np.sort(_hashes(" ".join(v))) for k, v in FUNCTION_WORDS.items()}


def languages(w: Words) -> np.ndarray:
    """The index in LANGUAGES of each row: that with the most function words."""
    votes = np.stack([np.bincount(w.row[np.isin(w.hash, h)], minlength=w.rows) for h in _FUNCTION.values()], 1)
    return np.where(votes.max(1) > 0, votes.argmax(1), len(FUNCTION_WORDS))


class Model:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (BUCKETS, DIMS)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (k * DIMS, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.base = np.float32(-2)
        self.shift = np.zeros(len(LANGUAGES))
        self.trained = False

    def features(self, b: np.ndarray) -> np.ndarray:
        x = self.table[b[:, 0]]
        for i in range(1, 4):
            x = x + self.table[b[:, i]]
        return x

    def pooled(self, x: np.ndarray, first: np.ndarray, at: bool = False, which: np.ndarray | None = None):
        """(rows, filters): each filter's rectified maximum over a row's words; with ``at``, where it stands (-1: nowhere).

        With ``which``, x has the distinct words and ``which`` the row of x of each word.
        """
        rows, n = len(first) - 1, len(x) if which is None else len(which)
        out, where = np.zeros((rows, FILTERS * len(WIDTHS)), np.float32), np.full((rows, FILTERS * len(WIDTHS)), -1)
        for j, k in enumerate(WIDTHS):
            if n < k:
                continue
            if which is None:
                z = np.concatenate([x[i : n - k + 1 + i] for i in range(k)], 1) @ self.filters[j] + self.bias[j]
            else:
                z = sum(((x @ self.filters[j][i * DIMS : (i + 1) * DIMS])[which[i : n - k + 1 + i]] for i in range(k)), start=self.bias[j])
            stop = first[1:] - k + 1
            use = np.flatnonzero(stop > first[:-1])
            if not len(use):
                continue
            for s in range(1, k):  # spans that cross from one row into the next
                cross = first[1:-1] - s
                z[cross[(cross >= 0) & (cross < len(z))]] = -np.inf
            best = np.maximum.reduceat(z, first[use], axis=0)
            if at:
                for u, r in enumerate(use):
                    where[r, j * FILTERS : (j + 1) * FILTERS] = np.where(best[u] > 0, first[r] + z[first[r] : stop[r]].argmax(0), -1)
            out[use, j * FILTERS : (j + 1) * FILTERS] = np.maximum(best, 0)
        return (out, where) if at else out

    def logits(self, w: Words) -> np.ndarray:
        _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
        return self.pooled(self.features(buckets(w, one)), w.first, which=which) @ self.out + self.base

    def scores(self, w: Words) -> np.ndarray:
        if not self.trained:
            return np.zeros(w.rows)
        z = SHARPNESS * (self.logits(w).astype(np.float64) - self.shift[languages(w)]) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))



def fit(texts: list[str], labels: np.ndarray, keep: np.ndarray, seed: int = 0) -> Model:
    """Train on the rows of ``keep``, calibrate thresholds on all others (on all, if none are left)."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if len(set(labels[keep].tolist())) < 2:
        return model
    model.trained = True
    raw, offsets = string_parts(pa.array(texts, pa.large_string()))
    rows: list[np.ndarray] = []
    langs = np.zeros(len(texts), int)
    for lo, hi in pieces(offsets):
        w = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM, True)
        b = buckets(w)
        langs[lo:hi] = languages(w)
        rows += [b[w.first[r] : w.first[r + 1]] for r in range(hi - lo)]
    y = labels.astype(np.float32)
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    train = np.flatnonzero(keep)
    for r in train:
        (pos if y[r] else neg)[np.unique(rows[r])] += 1
    n1, n0 = y[train].sum(), (1 - y[train]).sum()
    prior = PRIOR * n1 / (n1 + n0)  # PRIOR documents of the usual mixture: a bucket of few documents says little
    model.table[:, 0] = np.log((pos + prior) / (neg + PRIOR - prior) * (n0 / n1))
    model.table[:, 0] = np.clip(model.table[:, 0], -1, 4)
    for j, k in enumerate(WIDTHS):
        f = model.filters[j].reshape(k, DIMS, FILTERS)
        f[:, 0] = np.abs(f[:, 0]) * 0.5
        f[0, 0] += 0.2
        model.bias[j] -= 1.0
    squares = [np.full(BUCKETS, 1e-2, np.float32), [np.full_like(f, 1e-2) for f in model.filters], [np.full_like(b, 1e-2) for b in model.bias], np.full_like(model.out, 1e-2), 1e-2]

    def step(value, grad, sq):
        sq += grad * grad
        value -= RATE * grad / np.sqrt(sq)

    weight = np.where(y == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * (n1 + n0)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
            b = np.concatenate([rows[r] for r in part])
            first = np.concatenate([[0], np.cumsum([len(rows[r]) for r in part])])
            x = model.features(b)
            p, where = model.pooled(x, first, at=True)
            z = p @ model.out + model.base
            g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            up = g[:, None] * model.out
            step(model.out, p.T @ g + 1e-4 * model.out, squares[3])
            squares[4] += float(g.sum()) ** 2
            model.base -= np.float32(RATE * g.sum() / np.sqrt(squares[4]))
            dx: dict[int, np.ndarray] = {}
            for j, k in enumerate(WIDTHS):
                df, db = np.zeros_like(model.filters[j]), np.zeros_like(model.bias[j])
                for f in range(FILTERS):
                    c = j * FILTERS + f
                    on = np.flatnonzero(where[:, c] >= 0)
                    at = where[on, c]
                    if not len(on):
                        continue
                    span = x[at[:, None] + np.arange(k)].reshape(len(on), -1)
                    df[:, f] = up[on, c] @ span
                    db[f] = up[on, c].sum()
                    back = up[on, c][:, None] * model.filters[j][:, f]
                    for i, a in enumerate(at):
                        for s in range(k):
                            dx[a + s] = dx.get(a + s, 0) + back[i, s * DIMS : (s + 1) * DIMS]
                step(model.filters[j], df + 1e-4 * model.filters[j], squares[1][j])
                step(model.bias[j], db, squares[2][j])
            if dx:
                at = np.fromiter(dx, int)
                grad = np.stack(list(dx.values())).astype(np.float32)
                for i in range(4):
                    np.add.at(squares[0], b[at, i], (grad * grad).mean(1))
                    np.subtract.at(model.table, b[at, i], RATE * grad / np.sqrt(squares[0][b[at, i]])[:, None])
    held = np.flatnonzero(~keep) if (~keep).sum() >= 20 else np.arange(len(texts))
    z = np.array([model.pooled(model.features(rows[r]), np.array([0, len(rows[r])]))[0] @ model.out + model.base for r in held])
    overall = best_cut(z, y[held])
    for i in range(len(LANGUAGES)):
        own = langs[held] == i
        both = own.any() and 3 <= y[held][own].sum() < own.sum()
        model.shift[i] = best_cut(z[own], y[held][own]) if both else overall
    return model


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which the F1 of z >= cut is best (of equal ones the widest gap)."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(y.sum(), 1))
    nxt = np.append(z[1:], z[-1] - 2)
    f1[nxt == z] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax((z - nxt)[best])]
    return float((z[k] + nxt[k]) / 2)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Fit on the driver from at most ``limit`` labelled rows. A fifth of them calibrates the thresholds."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.pmod(crc, F.lit(3)) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bounded = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(limit)
    got = docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").dropDuplicates(["doc_id"]).orderBy("h", "doc_id").select("h", "toxic", "text").collect()
    if not got:
        return Model()
    y = np.array([r["toxic"] for r in got])
    keep = np.array([i % 5 != 0 for i in range(len(got))])
    return fit([r["text"] or "" for r in got], y, keep)


DDL = "doc_id long, held_out boolean, score double, predicted int, language string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("language", pa.string())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document; one pass, no shuffle. The model is of fixed size (4 MB)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, w in words_of(b.column(1), ALNUM, True):
                s = sent.value.scores(w)
                own = ids.slice(lo, hi - lo)
                yield batch(_SCHEMA, doc_id=own, held_out=[i is not None and held_out(i) for i in own.to_pylist()], score=s, predicted=(s >= CUT).astype(np.int32), language=[LANGUAGES[i] for i in languages(w)])

    return docs.select("doc_id", "text").mapInArrow(run, DDL)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            ok = [sent.value.scores(w) < CUT for _, _, w in words_of(text, ALNUM, True)]
            yield b.filter(pa.array(np.concatenate(ok))) if ok else b

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
