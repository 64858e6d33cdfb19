"""Evaluation passages inside a corpus, found by an FM-index per shard of the corpus.

Texts and items are reduced to words as a reader sees them (``visible``).  A phrase can match only
where ``words`` consecutive words are all words of some item, so a shard indexes exactly those
stretches: a word outside the items' vocabulary is a separator.  That is an exact change of
alphabet, not a filter on texts.  Over the shard's symbols an FM-index is built; all phrases of
``words`` words of all items are searched backward through the ranks of a wavelet matrix, their
occurrences located from sampled suffix positions, and overlapping ones merged to removal spans.

A shard is a run of rows of one partition, so nothing is shuffled.  The items are broadcast in
blocks of bounded size, each built alone on the driver; a shard is parsed once and searched for every
block, a task holding one at a time.

Null, empty and blank texts leak nothing; items of fewer words than ``words`` are never found.  Each
row of the corpus is judged on its own, so copies are all reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.llm.bpe import chunks_by_bytes
from gyrolith.llm.fmindex import FMIndex
from gyrolith.llm.hashing import HashTable
from gyrolith.llm.utf8 import MASKS, NUMBER, characters, words64
from gyrolith.llm.visible import visible
from gyrolith.session import ship

WORDS = 12
#: Most text of items that travels with a task; a larger table is searched in several blocks.
ITEM_BLOCK_CHARS = 8_000_000
SHARD_BYTES = 16 << 20
LONGEST = 24


def text_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of all texts on end; start, size and text number of each word in them."""
    data = [t.encode("utf-8") for t in texts]
    size = np.fromiter(map(len, data), np.int64, len(data)) + 1
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8).copy()
    upper = (raw >= 65) & (raw <= 90)
    raw[upper] |= 32
    pos, cls = characters(raw)
    inside = cls <= NUMBER
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if pos is not None:
        first, last = pos[first], np.r_[pos, len(raw)][last]
    ends = np.cumsum(size)
    return raw, first, last - first, np.searchsorted(ends, first, "right")


def _fingerprints(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The three eight-byte words of each short word, and a 62-bit mix of them."""
    eight = words64(raw)
    parts = [eight[np.minimum(start + 8 * k, len(eight) - 1)] & MASKS[np.clip(size - 8 * k, 0, 8)] for k in range(3)]
    with np.errstate(over="ignore"):
        mix = parts[0] * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
        mix = (mix + parts[1]) * np.uint64(0xBF58476D1CE4E5B9)
        mix ^= mix >> np.uint64(32)
        mix = (mix + parts[2]) * np.uint64(0x94D049BB133111EB)
    return parts, (mix >> np.uint64(2)).astype(np.int64)


class Lexicon:
    """The items' words as symbols 1, 2, ..."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.symbol = {w: k + 1 for k, w in enumerate(words)}
        short = [k for k, w in enumerate(words) if len(w) <= LONGEST]
        self.long = {w: k + 1 for k, w in enumerate(words) if len(w) > LONGEST}
        raw = np.frombuffer(b"".join(words[k] for k in short) or b"\0", np.uint8)
        size = np.array([len(words[k]) for k in short], np.int64)
        start = np.cumsum(np.r_[0, size])[:-1]
        self.parts, mix = _fingerprints(raw, start, size)
        self.ids = np.array(short, np.int64) + 1
        if len(np.unique(mix)) < len(mix):  # words that share a mix are told apart by name
            _, again, count = np.unique(mix, return_inverse=True, return_counts=True)
            for k in np.flatnonzero(count[again] > 1):
                self.long[words[short[k]]] = short[k] + 1
            keep = count[again] == 1
            self.parts, mix, self.ids = [p[keep] for p in self.parts], mix[keep], self.ids[keep]
        self.table = HashTable(mix)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[mix & 0xFFFF] = True

    def symbols(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 outside the lexicon."""
        out = np.zeros(len(start), np.int64)
        parts, mix = _fingerprints(raw, start, size)
        rows = np.flatnonzero((size <= LONGEST) & self.maybe[mix & 0xFFFF])
        found = self.table.find(mix[rows])
        rows, found = rows[found >= 0], found[found >= 0]
        same = np.ones(len(rows), bool)
        for mine, theirs in zip(self.parts, parts):
            same &= mine[found] == theirs[rows]
        out[rows[same]] = self.ids[found[same]]
        if self.long:
            lengths = np.array(sorted({len(w) for w in self.long}))
            data = raw.tobytes()
            for k in np.flatnonzero(np.isin(size, lengths)).tolist():
                out[k] = self.long.get(data[start[k] : start[k] + size[k]], out[k])
        return out


@dataclass
class Phrases:
    lexicon: Lexicon
    windows: np.ndarray  # distinct phrases, one a row
    owner_first: np.ndarray  # items that hold phrase k: owners[owner_first[k]:owner_first[k + 1]]
    owners: np.ndarray


def phrases_of(items: list[tuple[int, str]], words: int) -> Phrases:
    texts = [visible(t or "") for _, t in items]
    raw, start, size, doc = text_words(texts)
    data = raw.tobytes()
    spans = [data[a : a + n] for a, n in zip(start.tolist(), size.tolist())]
    lexicon = Lexicon(sorted(set(spans)))
    sym = np.array([lexicon.symbol[s] for s in spans], np.int64)
    rows, owner = [], []
    for k in range(len(sym) - words + 1):
        if doc[k] == doc[k + words - 1]:
            rows.append(sym[k : k + words])
            owner.append(items[doc[k]][0])
    if not rows:
        return Phrases(lexicon, np.zeros((0, words), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    windows, code = np.unique(np.stack(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([code.ravel(), np.array(owner, np.int64)], axis=1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
    return Phrases(lexicon, windows, first, pairs[:, 1])


Words = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def leaks_in(texts: list[str], phrases: Phrases) -> list[np.ndarray]:
    """Spans in a shard: text number, item, first word, number of words, as four columns."""
    return leaks_among(text_words([visible(t) for t in texts]), phrases)


def leaks_among(parsed: Words, phrases: Phrases) -> list[np.ndarray]:
    """The same of a shard's words, parsed once for all blocks of items."""
    words = phrases.windows.shape[1]
    none = [np.zeros(0, np.int64)] * 4
    raw, start, size, doc = parsed
    if not len(start) or not len(phrases.windows):
        return none
    sym = phrases.lexicon.symbols(raw, start, size)
    known = sym > 0
    if not known.any():
        return none
    head = known & np.r_[True, ~known[:-1] | (doc[1:] != doc[:-1])]
    run = np.cumsum(head) - 1
    length = np.bincount(run[known], minlength=int(run[-1]) + 1)
    keep = np.flatnonzero(known & (length[np.maximum(run, 0)] >= words))
    if not len(keep):
        return none
    # stretches of item words on end, a separator after each
    part = np.cumsum(head[keep]) - 1
    place = np.arange(len(keep)) + part
    seq = np.zeros(len(keep) + int(part[-1]) + 1, np.int64)
    seq[place] = sym[keep]
    word_at = np.zeros(len(seq), np.int64)
    word_at[place] = keep
    index = FMIndex(seq, len(phrases.lexicon.words))
    lo, hi = index.search(phrases.windows)
    hits = np.flatnonzero(hi > lo)
    if not len(hits):
        return none
    count = hi[hits] - lo[hits]
    rows = np.repeat(lo[hits] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    phrase = np.repeat(hits, count)
    at = word_at[index.locate(rows)]
    many = phrases.owner_first[phrase + 1] - phrases.owner_first[phrase]
    pick = np.repeat(phrases.owner_first[phrase] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    at = np.repeat(at, many)
    item, where = phrases.owners[pick], doc[at]
    o = np.lexsort((at, item, where))
    at, item, where = at[o], item[o], where[o]
    new = np.r_[True, (item[1:] != item[:-1]) | (where[1:] != where[:-1]) | (at[1:] > at[:-1] + words)]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(at)] - 1
    first_word = np.searchsorted(doc, where[begin])
    return [where[begin], item[begin], at[begin] - first_word, at[end] + words - at[begin]]


def leaked_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = WORDS) -> DataFrame:
    """Removal spans: (key, item_key, first_word, n_words), words counted as a reader sees them."""
    ship(docs.sparkSession)
    told = items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("t")).dropna()
    size = told.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = int(size // ITEM_BLOCK_CHARS) + 1
    rows = docs.select(key, text).where(F.col(text).isNotNull())
    kind = rows.dtypes[0][1]
    schema = f"`{key}` {kind}, `{item_key}` bigint, first_word bigint, n_words bigint"

    # one block of items at a time on the driver, then as a file that executors fetch
    told_to = []
    for b in range(blocks):
        some = told if blocks == 1 else told.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)
        told_to.append(docs.sparkSession.sparkContext.broadcast(phrases_of([(r.k, r.t) for r in some.toLocalIterator()], words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_by_bytes(batch, text, SHARD_BYTES):
                parsed = text_words([visible(t) for t in part.column(text).to_pylist()])
                for block in told_to:
                    where, item, first, n = leaks_among(parsed, block.value)
                    if len(told_to) > 1:
                        del block._value  # a task holds one block at a time; it is read again from the fetched file
                    if len(where):
                        yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(where)), pa.array(item), pa.array(first), pa.array(n)], [key, item_key, "first_word", "n_words"])

    return rows.mapInArrow(run, schema)
