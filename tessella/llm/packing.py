"""Token sequences of near-equal fill by Karmarkar-Karp multiway differencing.

A document's tokens are cut into whole sequences of WINDOW tokens, which need no packing, and a rest. Rests, cut to at
most CUT tokens, gather until they fill BATCH windows. Each starts as a partial partition that holds it in one slot;
the two partitions of the largest spread are merged, the fullest slot of one with the emptiest of the other, until one
is left: windows of nearly equal sums. Where its fullest window exceeds WINDOW, the window count rises by one and the
differencing runs again. A task packs its own documents, so nothing is shuffled; a task's last batch may be small.

Tokens come from `tokenizers`. A text is cut into the vocabulary's pre-tokens with numpy, and each distinct one is
encoded once while its ids stay in a bounded cache, which a Python worker keeps from task to task; those not known yet are
encoded as one text. Texts with characters outside the table of classes, or with one of the vocabulary's added tokens,
are encoded as they are. Null text is empty: a document then has the end token alone. Repeated rows are packed each; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, pieces, span_hash, string_parts, trim

WINDOW, CUT, BATCH, END = 1024, 256, 48, 0
CACHE, STORE, AT_ONCE, PIECE = 19, 1 << 20, 1 << 15, 1 << 16  # bits of a pre-token's slot in the cache; ids kept; characters that are encoded at once; bytes of a piece

_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = range(5)
#: White_Space, a fixed value
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def classes(size: int = 0x2100) -> np.ndarray:
    """The class of each code point below ``size``; unassigned ones, and by convention all above, are unknown."""
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.array([_UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kind.get(c[0], _OTHER) for i in range(size)], np.uint8)
    out[[c for c in WHITE if c < size]] = _SPACE
    return out


def pretoken_starts(code: np.ndarray, cls: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. ``edge`` marks where texts begin; the rules are those of the byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ whitespace, L, N]+|whitespace before whitespace or the end|whitespace
    """
    n = len(code)
    if not n:
        return np.zeros(0, bool)
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 9, cls[:-1]
    prev[edge[:n]] = 9
    run = prev != cls  # a run of one class begins
    blank = code == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1] & ~edge[1:n]
    start = run & ~((cls != _SPACE) & after_blank)
    last = np.zeros(n, bool)  # whitespace before another character of the same text
    last[:-1] = (cls[:-1] == _SPACE) & (cls[1:] != _SPACE) & ~edge[1:n]
    start |= last
    quotes = np.flatnonzero((code == 39) & start)
    for i in quotes:  # contractions
        if i + 1 < n and not edge[i + 1]:
            two = i + 2 < n and not edge[i + 2]
            tail = chr(code[i + 1])
            size = 2 if tail in "stmd" else 3 if two and tail + chr(code[i + 2]) in ("re", "ve", "ll") else 0
            if size and start[i]:
                start[i + 1 : i + size] = False
                if i + size < n and not edge[i + size] and cls[i + size] == _LETTER:
                    start[i + size] = True
    return start


class Encoder:
    """ids of texts, by ``tokenizers``, with a cache of pre-tokens: a table in which a new one takes the slot of an old one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token, each of which is one character there
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        self.classes = classes()
        self.keys = np.zeros(1 << CACHE, np.uint64)
        self.first, self.size = np.zeros(1 << CACHE, np.int32), np.zeros(1 << CACHE, np.int32)
        self.ids, self.used = np.zeros(STORE, np.uint32), 0

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def store(self, ids: np.ndarray) -> int:
        """Where ``ids`` stand from now on. A full store keeps what slots still name, or is doubled."""
        if self.used + len(ids) > len(self.ids):
            live = np.flatnonzero(self.size)
            kept = taken(self.ids, self.first[live], self.size[live])
            self.first[live] = np.cumsum(self.size[live], dtype=np.int64) - self.size[live]
            room = len(self.ids)
            while 2 * (len(kept) + len(ids)) > room:
                room *= 2
            self.ids, self.used = np.concatenate([kept, np.zeros(room - len(kept), np.uint32)]), len(kept)
        at = self.used
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def learn(self, code: np.ndarray, cls: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each) of distinct pre-tokens of a piece.

        All but runs of whitespace form one text: a pre-token that begins with a space stands for itself anywhere, others
        follow a line feed, whose id is left out. Widths of the ids in bytes tell the pre-tokens apart.
        """
        size = np.zeros(len(start), np.int64)
        blank = cls[end - 1] == _SPACE
        order, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        words = np.flatnonzero(~blank)
        for j in np.array_split(words, -(-int((end[words] - start[words]).sum()) // AT_ONCE)) if len(words) else ():
            bare = code[start[j]] != 32
            n = end[j] - start[j] + bare
            one = taken(code, start[j] - bare, n)
            one[np.cumsum(n)[bare] - n[bare]] = 10
            ids = np.array(self.plain([one.tobytes().decode("utf-32-le")])[0], np.uint32)
            wide = np.cumsum(1 + (one >= 0x80) + (one >= 0x800) + (one >= 0x10000))[np.cumsum(n) - 1]
            stop = np.searchsorted(np.cumsum(self.width[ids]), wide) + 1
            size[j] = np.diff(stop, prepend=0) - bare
            keep = np.ones(len(ids), bool)
            keep[np.append(0, stop[:-1])[bare]] = False
            order.append(j)
            parts.append(ids[keep])
        j = np.flatnonzero(blank)
        if len(j):
            got = self.plain([code[a:b].tobytes().decode("utf-32-le") for a, b in zip(start[j], end[j], strict=True)])
            size[j] = list(map(len, got))
            order.append(j)
            parts.append(np.array([i for g in got for i in g], np.uint32))
        first, at = np.empty(len(start), np.int64), np.concatenate(order)
        first[at] = np.cumsum(size[at]) - size[at]
        return taken(np.concatenate(parts), first, size), size

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a piece."""
        text = raw.tobytes().decode()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets] if len(raw) else np.zeros(len(offsets), np.int64)
        if len(code) == 0:
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        cls = np.where(code < len(self.classes), self.classes[np.minimum(code, len(self.classes) - 1)], _UNKNOWN).astype(np.uint8)
        edge = np.zeros(len(code) + 1, bool)
        edge[begins] = True
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(begins, np.flatnonzero(cls == _UNKNOWN), "right") - 1] = True
        for word in self.added:
            at = text.find(word)
            while at >= 0:
                odd[np.searchsorted(begins, at, "right") - 1] = True
                at = text.find(word, at + 1)
        start = np.flatnonzero(pretoken_starts(code, cls, edge))
        end = np.append(start[1:], len(code))
        row = np.searchsorted(begins, start, "right") - 1
        ok = ~odd[row]
        start, end, row = start[ok], end[ok], row[ok]
        keys = span_hash(code.astype(np.uint64), start, end)
        slot = (keys >> np.uint64(64 - CACHE)).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != keys)
        if len(new):
            uniq, index, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            ids, count = self.learn(code, cls, start[new[index]], end[new[index]])
            place = self.store(ids) + np.cumsum(count) - count  # may move what slots name
        first, size = self.first[slot].astype(np.int64), self.size[slot].astype(np.int64)
        if len(new):
            first[new], size[new] = place[inverse], count[inverse]
            at = slot[new[index]]
            self.keys[at], self.first[at], self.size[at] = uniq, place, count
        stop = np.cumsum(size)
        flat = taken(self.ids, first, size)
        cut = np.concatenate([[0], stop])[np.searchsorted(row, np.arange(len(offsets)))]
        out = [flat[cut[r] : cut[r + 1]] for r in range(len(offsets) - 1)]
        for r in np.flatnonzero(odd):
            out[r] = np.array(self.plain([text[begins[r] : begins[r + 1]]])[0], np.uint32)
        return out


def taken(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[first:first + size] of each, one after the other; a first of -1 stands for any value."""
    stop = np.cumsum(size, dtype=np.int64)
    return values[np.maximum(np.repeat(first - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0), 0)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_at(path: str) -> Encoder:
    """The encoder of a vocabulary file; a worker makes it once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        trim()  # what parsing the file has left
    return _ENCODERS[path]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items of each of ``windows`` windows with nearly equal sums: Karmarkar and Karp's largest differencing.

    Sums are kept fullest first. A merge notes only where its slots came from; the items of a slot are found from the
    last merge downwards.
    """
    if not sizes:
        return []
    first = np.zeros((len(sizes), windows), np.int64)
    first[:, 0] = sizes
    heap = [(-s, i, first[i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heap[0]
        sums = a + b[::-1]
        order = (-sums).argsort(kind="stable")
        sums = sums[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), len(sizes) + len(merges), sums))
        merges.append((i, j, order))
    window_of = {heap[0][1]: np.arange(windows)}  # by partial partition: the window of each of its slots
    for k in range(len(merges) - 1, -1, -1):
        i, j, order = merges[k]
        w = window_of.pop(len(sizes) + k)
        mine, theirs = np.empty(windows, np.int64), np.empty(windows, np.int64)
        mine[order], theirs[windows - 1 - order] = w, w
        window_of[i], window_of[j] = mine, theirs
    out: list[list[int]] = [[] for _ in range(windows)]
    for i in range(len(sizes)):
        out[window_of[i][0]].append(i)
    return out


def windows_of(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows of at most ``window``: the fewest that could hold the items, one more each time one overflows."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        slots = differencing(sizes, k)
        if max(sum(sizes[i] for i in s) for s in slots) <= window:
            return [s for s in slots if s]
        k += 1


DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(f.split()[0], pa.int64()) for f in DDL.split(", ")])


def _pack(vocabulary: str | None, window: int, cut: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        encoder, sequence = encoder_at(vocabulary or public_tokenizers.path("byte_bpe_50k.json")), TaskContext.get().partitionId() << 32
        done: list[tuple] = []
        rests: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal sequence, rests, held
            for slot in windows_of([p[2] for p in rests], window) if rests else ():
                at = 0
                for i in slot:
                    done.append((*rests[i], sequence, at))
                    at += rests[i][2]
                sequence += 1
            rests, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * len(_SCHEMA)
            done.clear()
            return batch(_SCHEMA, **dict(zip(_SCHEMA.names, columns, strict=True)))

        for b in batches:
            ids = b.column(0).to_pylist()
            raw, offsets = string_parts(b.column(1))
            for lo, hi in pieces(offsets, PIECE):
                for r, tokens in enumerate(encoder.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), lo):
                    tokens = np.append(tokens, np.uint32(END)).astype("<u4")
                    n, at = len(tokens), 0
                    while at < n:
                        size = window if n - at >= window else min(cut, n - at)
                        piece = (ids[r], at, size, zlib.crc32(tokens[at : at + size].tobytes()), n)
                        if size == window:
                            done.append((*piece, sequence, 0))
                            sequence += 1
                        else:
                            rests.append(piece)
                            held += size
                        at += size
                    if held >= window * group:
                        close()
                if len(done) >= 20_000:
                    yield flush()
            trim()
        close()
        yield flush()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, cut: int = CUT, group: int = BATCH) -> DataFrame:
    """One row per piece. ``vocabulary`` is the path of a tokenizer file that the executors have."""
    return docs.select("doc_id", "text").mapInArrow(_pack(vocabulary, window, cut, group), DDL)


def op8_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
