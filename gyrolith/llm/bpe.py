"""Encoding of a corpus by a public byte-level BPE vocabulary.

A partition's texts are taken in chunks.  A chunk is cut into pre-tokens in bulk on its bytes, equal
pre-tokens are brought together, and those not met before in this worker are merged all at once
over a *pair occurrence index*: each adjacent pair's rank maps to all its positions in the chunk;
active ranks are applied in ascending order, each to its whole list of positions, and the lists of
the pairs this makes are extended.  A merge makes only pairs of higher rank (they hold the token it
created), so one ascending pass is the whole encoding.

The vocabulary file stays outside the repository: ``tokenizer`` is its path.  Strings of special
tokens are ordinary text.  Null and empty texts give an empty list.  Texts of any length are
encoded whole; a chunk is at least one text.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from gyrolith.llm.utf8 import LETTER, MASKS, OTHER, SPACE, characters, string_parts, words64
from gyrolith.session import ship

CHUNK_BYTES = 16 << 20
#: Pre-tokens remembered by a worker; beyond it the memory starts anew, which changes no result.
MEMORY = 1_000_000


class Vocabulary:
    """Byte ids and merges of a byte-level BPE file in the JSON form of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # the usual printable stand-ins for bytes: printable Latin-1 stands for itself, the rest from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = self.left * self.size + self.right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of = key[order], order.astype(np.int32)
        self.none = len(merges)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], self.none)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pretoken_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions at which the pattern of byte-level BPE starts a pre-token.

    The pattern: contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers, of other
    characters, each with the blank before it; white space up to, or up to but one before, what
    follows it.
    """
    pos, cls = characters(raw)
    n = len(cls)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    if pos is None:
        byte, where = raw, None
        first[np.minimum(off[:-1], n)] = True
    else:
        byte, where = raw[pos], pos
        first[np.searchsorted(pos, off[:-1])] = True
    ends = first[1:].copy()
    ends[-1] = True
    first = first[:-1]
    first[0] = True
    white = cls == SPACE
    start = np.r_[True, cls[1:] != cls[:-1]] | first
    # the last of several white characters before something else stands alone or leads it
    run_end = white & ~ends & ~np.r_[white[1:], True]
    start |= run_end
    # a run is led by a blank right before it in the same text
    led = np.r_[False, byte[:-1] == 32] & ~white & ~first
    start &= ~led
    # contractions begin at an apostrophe that starts a pre-token of its own run
    q = np.flatnonzero((byte == 39) & start)
    q = q[q + 1 < n]
    q = q[~ends[q]]
    if len(q):
        b1 = byte[q + 1]
        two = np.isin(b1, np.frombuffer(b"stmd", np.uint8))
        nxt = np.minimum(q + 2, n - 1)
        b2 = np.where((q + 2 < n) & ~ends[q + 1], byte[nxt], 0)
        three = ((b1 == 114) | (b1 == 118)) & (b2 == 101) | (b1 == 108) & (b2 == 108)
        for at, size in ((q[two], 2), (q[three & ~two], 3)):
            for k in range(1, size):
                start[at + k] = False
            after = at + size
            after = after[(after < n) & ~ends[at + size - 1]]
            start[after] = True
    at = np.flatnonzero(start)
    return at if where is None else where[at]


def same_spans(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each byte span, equal spans alike, and of each code one span's index."""
    eight = words64(raw)
    code = np.empty(len(start), np.int64)
    example: list[np.ndarray] = []
    total = 0

    def take(rows: np.ndarray, codes: np.ndarray, n: int) -> None:
        nonlocal total
        code[rows] = codes + total
        one = np.empty(n, np.int64)
        one[codes] = rows
        example.append(one)
        total += n

    short = size < 8
    rows = np.flatnonzero(short)
    s = size[rows]
    key = (eight[start[rows]] & MASKS[s]) | (s.astype(np.uint64) << np.uint64(56))
    codes, uniq = pd.factorize(key)
    take(rows, codes, len(uniq))
    rows = np.flatnonzero(~short & (size < 16))
    s = size[rows]
    a, ua = pd.factorize(eight[start[rows]])
    b, ub = pd.factorize((eight[start[rows] + 8] & MASKS[s - 8]) | (s.astype(np.uint64) << np.uint64(56)))
    codes, uniq = pd.factorize(a.astype(np.int64) * max(len(ub), 1) + b)
    take(rows, codes, len(uniq))
    rows = np.flatnonzero(size >= 16)
    if len(rows):
        data = raw.tobytes()
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(data[x : x + y], len(known)) for x, y in zip(start[rows].tolist(), size[rows].tolist())), np.int64, len(rows))
        take(rows, codes, len(known))
    return code, np.concatenate(example)


def merge_words(symbols: np.ndarray, word: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All merges of all words (``word`` numbers each symbol's word, ascending): ids and their words."""
    n = len(symbols)
    sym = symbols.astype(np.int32)
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    cut = np.flatnonzero(word[1:] != word[:-1])
    nxt[cut] = n
    nxt[-1:] = n
    prv[cut + 1] = -1
    alive = np.ones(n, bool)
    occurrences: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def index(at: np.ndarray) -> None:
        """Enter the pairs that begin at these positions."""
        at = at[nxt[at] < n]
        if not len(at):
            return
        rank = voc.ranks(sym[at], sym[nxt[at]])
        on = rank < voc.none
        at, rank = at[on], rank[on]
        if not len(at):
            return
        if len(at) == 1:
            groups = [(int(rank[0]), at)]
        else:
            o = np.argsort(rank, kind="stable")
            at, rank = at[o], rank[o]
            bound = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            firsts = [0, *bound.tolist(), len(at)]
            heads = rank[np.r_[0, bound]].tolist()
            groups = [(r, at[firsts[k] : firsts[k + 1]]) for k, r in enumerate(heads)]
        for r, some in groups:
            have = occurrences.get(r)
            if have is None:
                occurrences[r] = [some]
                heapq.heappush(active, r)
            else:
                have.append(some)

    index(np.arange(n))
    while active:
        r = heapq.heappop(active)
        lists = occurrences.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b, made = voc.left[r], voc.right[r], voc.made[r]
        to = nxt[at]
        ok = alive[at] & (sym[at] == a) & (to < n)
        at, to = at[ok], to[ok]
        ok = sym[to] == b
        at = np.unique(at[ok])
        if not len(at):
            continue
        if a == b and len(at) > 1:  # of overlapping pairs every second one, from the left
            head = np.r_[True, nxt[at[:-1]] != at[1:]]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
        to = nxt[at]
        sym[at] = made
        alive[to] = False
        beyond = nxt[to]
        nxt[at] = beyond
        inside = beyond < n
        prv[beyond[inside]] = at[inside]
        before = prv[at]
        before = before[before >= 0]
        index(at if not len(before) else np.unique(np.concatenate([at, before])))
    return sym[alive], word[alive]


class Encoder:
    """Encodes chunks of text, remembering the pre-tokens it has met."""

    def __init__(self, path: str) -> None:
        self.voc = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self, new: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(new), np.uint8)
        size = np.fromiter(map(len, new), np.int64, len(new))
        ids, word = merge_words(self.voc.byte_id[raw], np.repeat(np.arange(len(new)), size), self.voc)
        count = np.bincount(word, minlength=len(new))
        start = len(self.known)
        self.known.update(zip(new, range(start, start + len(new))))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, col: pa.Array) -> pa.Array:
        raw, off = string_parts(col)
        n = len(col)
        if not len(raw):
            return pa.array([[]] * n, pa.list_(pa.int32()))
        start = pretoken_starts(raw, off)
        size = np.diff(np.r_[start, len(raw)])
        code, example = same_spans(raw, start, size)
        data = raw.tobytes()
        spans = [data[x : x + y] for x, y in zip(start[example].tolist(), size[example].tolist())]
        if len(self.known) + len(spans) > MEMORY:
            self.forget()
        new = [s for s in spans if s not in self.known]
        if new:
            self.learn(new)
        entry = np.fromiter(map(self.known.__getitem__, spans), np.int64, len(spans))[code]
        begin, count = self.first[entry], self.first[entry + 1] - self.first[entry]
        total = np.cumsum(count)
        flat = self.ids[np.repeat(begin - (total - count), count) + np.arange(total[-1])]
        tokens = np.r_[0, total][np.searchsorted(start, off)]
        return pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(flat))


def chunks_by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of at most about ``limit`` bytes of text."""
    off = string_parts(batch.column(column))[1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def encode_corpus(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>), one for every row of ``df``; narrow, nothing is shuffled."""
    ship(df.sparkSession)
    rows = df.select(key, text)
    kind = rows.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part in chunks_by_bytes(batch, text, CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(key), encoder.encode(part.column(text))], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
