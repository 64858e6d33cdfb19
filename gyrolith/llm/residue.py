"""Template residue, filler, error pages and script notices, by labelled exemplars.

Exemplars (``exemplars``) are short passages of known residue with a label each.  Texts are cut into
units (``cells.units``); placeholders, failed-request numbers and names of things that vary (paths,
addresses, ids) are written alike, and words are taken as a reader sees them.  Of every document two
things are gathered in one pass: the document frequency of each exemplar word, over all documents,
and the units that may be residue.  The frequencies give TF-IDF weights.  An inverted index from words
to exemplars retrieves a unit's exemplars; those of which the unit holds at least ``CUE`` of the weight
and ``PARTS`` of the words tell which labels it may have.  For each passage window of the unit, containment is the weight of its
words among the words of such a label's exemplars over the weight of all its words.  A word is covered
if some window around it is contained to at least ``CONTAINED``, and a unit is residue if at least
``COVERED`` of its weight is.

A word of no exemplar weighs ``UNKNOWN`` times the rarest word; one of them is taken for the thing a
message is about, where an exemplar has a list of things of which the unit names none.  A unit with
more other unknown words than ``_possible`` allows can't be covered to ``COVERED``, whatever the
weights: leaving those out in the first pass loses nothing.
A placeholder stands for text around it: up to ``REACH`` words on each side count as template.  Beside
two or more words of filler Latin, words with Latin endings count as filler too.

Numbers, ids, paths and addresses weigh nothing; code spans are no placeholders.  Null, empty and
blank texts are no residue; texts are taken whole at any length; equal documents are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.llm.bpe import chunks_by_bytes
from gyrolith.llm.cells import units
from gyrolith.llm.exemplars import COMMON, EXEMPLARS, LATIN, LISTS
from gyrolith.llm.leaks import Lexicon, text_words
from gyrolith.llm.visible import visible
from gyrolith.session import durable, ship

CUE, PARTS, CONTAINED, COVERED = 0.7, 0.6, 0.8, 0.8
#: What a word of no exemplar weighs, as a share of the rarest word.
UNKNOWN = 0.85
WINDOW, REACH = 10, 4
CHUNK_BYTES = 8 << 20

#: Words that stand for a placeholder, a failed request's number, and a word of filler Latin.
SLOT, CODE, MOCK = "placeholderslot", "failedrequestcode", "fillerlatinword"
#: Names of exception classes: a trace is no message, so such a word is of no label and never a thing.
TRACE = "nameofanexception"
_TRACE = re.compile(r"\b[A-Za-z]\w*(?:Error|Exception|Warning)\b")
_LEVELS = "INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|CRITICAL|OK|FAIL|FAILED|PASS|PASSED|DONE|NOTE|TODO|SKIP|SKIPPED|CLS|SEP|PAD|MASK|UNK|BOS|EOS"
_NAMED = r"(?:[Yy]our|[Ii]nsert|[Ee]nter|[Aa]dd|[Tt]ype|[Nn]ame of)"
# fixed values: the ways templates write a placeholder, each with what a text must hold for it
_SLOTS = [
    (mark, re.compile(pattern))
    for mark, pattern in (
        ("{", r"\{\{[^{}`\n]*[^\W\d][^{}`\n]*\}\}|\{%[^{}`\n]+%\}|[$#]\{[^{}`\n]+\}|(?<![\w^\\$#{])\{[A-Za-z_]{2,}\}"),
        ("<", rf"<(?:%=?[^<>%`\n]+%|<[^<>`\n]+>|(?!(?:{_LEVELS})>)[A-Z][A-Z_ -]+|{_NAMED} [^<>\n]+)>"),
        ("[", rf"\[(?:(?!(?:{_LEVELS})\])[A-Z][A-Z_ -]+|{_NAMED} [^\[\]\n]+)\]"),
        ("(", rf"\({_NAMED} \w+(?: \w+){{0,3}}\)"),
        ("%", r"%(?:%\w{2,}%|[A-Za-z_]{3,})%"),
        ("__", r"\b__[A-Z][A-Z_]+__"),
        ("@@", r"@@\w{2,}@@"),
        ("«", r"«\s*\w{2,}\s*»"),
        ("$", r"\$[A-Za-z_]{4,}\$"),
        ("xx", r"\bxx[A-Za-z]{3,}xx\b"),
    )
]
_X = re.compile(r"\bx{3,}\b", re.I)
_SPAN = re.compile(r"`[^`\n]+`")
_STATUS = re.compile(r"(?<![\w.])[45]\d\d(?![\w.]\w)")
# fixed values: ends of file names and host names
_ENDS = tuple(f".{x}{y}" for x in "ipynb py html htm php json csv txt md com org net io".split() for y in ("", ",", ".", ":", ";", ")", '"', '",'))
_CJK = re.compile("([\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3])")
_LATIN_END = re.compile(r"[a-z]*(?:a|ae|am|as|at|em|en|er|es|et|i|is|it|o|or|os|u|um|unt|ent|ant|ur|us|ix|ex|ax)")
_LATIN = sorted(set(LATIN.split()) - set(COMMON.split()) - {"error", "class", "integer", "sit", "do"})


def canonical(unit: str) -> str:
    """A unit with what varies written alike, as a reader sees it: no paths, addresses or mails."""
    if "`" in unit:
        unit = _SPAN.sub(" codespan ", unit)
    for mark, pattern in _SLOTS:
        if mark in unit:
            unit = pattern.sub(f" {SLOT} ", unit)
    if "Error" in unit or "Exception" in unit or "Warning" in unit:
        unit = _TRACE.sub(TRACE, unit)
    unit = visible(unit)
    if "/" in unit or "@" in unit or "." in unit:
        unit = " ".join([t for t in unit.split() if "/" not in t and "@" not in t and not t.endswith(_ENDS)])
    if _STATUS.search(unit):
        unit = _STATUS.sub(f" {CODE} ", unit)
    if "xxx" in unit or "XXX" in unit:
        unit = _X.sub("xxx", unit)
    if not unit.isascii():
        unit = _CJK.sub(r" \1 ", unit)
    return unit


class Exemplars:
    """The exemplars' lexicon, which words each label has, and the inverted index from words to exemplars."""

    def __init__(self, texts: dict[str, list[str]] = EXEMPLARS) -> None:
        self.labels = list(texts)
        special = {"SLOT": [SLOT], "CODE": [CODE]}
        named = {k: self._words(v) for k, v in LISTS.items()} | special
        flat = [(k, t) for k, label in enumerate(self.labels) for t in texts[label]]
        self.label = np.array([k for k, _ in flat])
        parts: list[list[list[str]]] = []  # an exemplar is a list of alternatives
        for _, t in flat:
            parts.append([])
            for token in t.split():
                options = [w for one in token.split("|") for w in (named[one.strip(",.:")] if one.strip(",.:") in named else self._words(one))]
                if len(token.split("|")) == 1 and token.strip(",.:") not in named:
                    parts[-1] += [[w] for w in options]
                elif options:
                    parts[-1].append(options)
        common = self._words(COMMON)
        lists = {"template": ["FIELD", "WRITE"], "error": ["THING", "FETCH", "GONE", "REASON"], "scripts": ["THING", "FETCH", "GONE", "SCRIPT", "ENABLE", "SUPPORT"]}
        words = sorted({w for e in parts for g in e for w in g} | set(common) | {w for v in named.values() for w in v} | set(_LATIN) | {MOCK, TRACE})
        self.lexicon = Lexicon([w.encode() for w in words])
        at = {w: k + 1 for k, w in enumerate(words)}
        self.slot, self.mock, self.trace, size = at[SLOT], at[MOCK], at[TRACE], len(words) + 1
        self.latin = np.zeros(size, bool)
        self.latin[[at[w] for w in _LATIN]] = True
        self.has = np.zeros((size, len(self.labels)), bool)
        self.has[[at[w] for w in common]] = True
        for e, k in zip(parts, self.label):
            self.has[[at[w] for g in e for w in g], k] = True
        for k, label in enumerate(self.labels):
            self.has[[at[w] for n in lists.get(label, []) for w in named[n]], k] = True
        if "filler" in self.labels:
            self.has[[at[w] for w in (*_LATIN, MOCK)], self.labels.index("filler")] = True
        # alternatives as rows of a table: which exemplar, which words
        if "filler" in self.labels:  # any two words of filler Latin
            self.label = np.r_[self.label, self.labels.index("filler")]
            parts.append([list(_LATIN[0::2]) + list(_LATIN[1::2]), [*_LATIN, MOCK]])
        self.group_of, self.members = [], []
        for n, e in enumerate(parts):
            for g in {tuple(sorted(set(g))) for g in e}:
                self.group_of.append(n)
                self.members.append(np.array([at[w] for w in g]))
        self.group_of = np.array(self.group_of)
        things = set(named["THING"]), set(named["FIELD"])
        self.listed = np.array([any(t <= {words[m - 1] for m in g} for t in things) for g in self.members])
        self.flat = np.concatenate(self.members)
        self.first = np.cumsum([0, *map(len, self.members)])[:-1]
        # inverted index: exemplars of a word
        owner = np.repeat(self.group_of, [len(m) for m in self.members])
        order = np.argsort(self.flat, kind="stable")
        self.posting, self.post_at = owner[order], np.searchsorted(self.flat[order], np.arange(size + 1))

    @staticmethod
    def _words(text: str) -> list[str]:
        raw, start, size, _ = text_words([_CJK.sub(r" \1 ", visible(text))])
        data = raw.tobytes()
        return [data[a : a + n].decode() for a, n in zip(start.tolist(), size.tolist())]

    def retrieved(self, symbols: np.ndarray) -> np.ndarray:
        """Exemplars that share a word with a unit."""
        some = [self.posting[self.post_at[x] : self.post_at[x + 1]] for x in np.unique(symbols[symbols > 0])]
        return np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)

    def cues(self, symbols: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, bool]:
        """Per label whether the unit holds most of some exemplar, and whether one of these lacks its thing."""
        out = np.zeros(len(self.labels), bool)
        mine = self.retrieved(symbols)
        if not len(mine):
            return out, False
        present = np.zeros(len(weight), bool)
        present[symbols] = True
        of = np.flatnonzero(np.isin(self.group_of, mine))
        whole = np.add.reduceat(weight[self.flat], self.first)[of] / np.array([len(self.members[k]) for k in of])
        held = np.logical_or.reduceat(present[self.flat], self.first)[of]
        total = np.bincount(self.group_of[of], whole, len(self.label))
        got = np.bincount(self.group_of[of], whole * held, len(self.label))
        # one word holds one part of an exemplar only
        parts = np.bincount(self.group_of[of], held, len(self.label))
        words = np.unique(symbols[symbols > 0])
        lists = np.concatenate([np.unique(self.posting[self.post_at[x] : self.post_at[x + 1]]) for x in words])
        distinct = np.bincount(lists, minlength=len(self.label))
        got = got * np.minimum(1.0, distinct / np.maximum(parts, 1))
        every = np.bincount(self.group_of[of], minlength=len(self.label))
        cued = (total > 0) & (got >= CUE * total) & (np.minimum(parts, distinct) >= PARTS * every)
        np.logical_or.at(out, self.label, cued)
        return out, bool((cued[self.group_of[of]] & self.listed[of] & ~held).any())


def _weightless(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words that are numbers (a digit at both ends) or ids (eight or more hexadecimal digits, one a number)."""
    digit = (raw >= 48) & (raw <= 57)
    out = digit[start] & digit[start + size - 1]
    long = np.flatnonzero((size >= 8) & ~out)
    a, b = start[long], start[long] + size[long]
    tens = np.r_[0, np.cumsum(digit, dtype=np.int32)]
    sixteens = np.r_[0, np.cumsum(digit | ((raw >= 97) & (raw <= 102)), dtype=np.int32)]
    out[long] = (sixteens[b] - sixteens[a] == size[long]) & (tens[b] > tens[a])
    return out


def _near_slots(symbols: np.ndarray, slot: int) -> np.ndarray:
    """Words within REACH of a placeholder."""
    at = np.flatnonzero(symbols == slot)
    edge = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edge, np.maximum(at - REACH, 0), 1)
    np.add.at(edge, np.minimum(at + REACH + 1, len(symbols)), -1)
    return np.cumsum(edge)[:-1] > 0


def _possible(known: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Whether known words, each weighing as the rarest, can cover a unit beside its unknown ones, of which one may be a thing."""
    return (known > 0) & (known * (1 - COVERED) >= COVERED * UNKNOWN * (unknown - 1))


def survey(texts: list[str], ex: Exemplars) -> tuple[np.ndarray, list[tuple[int, list[int]]]]:
    """Documents that hold each exemplar word, and the units that words of no exemplar leave possible."""
    flat, owner = [], []
    for k, t in enumerate(texts):
        for u in units(t, with_code=False):
            flat.append(canonical(u))
            owner.append(k)
    df = np.zeros(len(ex.lexicon.words) + 1, np.int64)
    if not flat:
        return df, []
    raw, start, size, unit = text_words(flat)
    counts = ~_weightless(raw, start, size)
    start, size, unit = start[counts], size[counts], unit[counts]
    sym = ex.lexicon.symbols(raw, start, size)
    doc = np.array(owner)[unit]
    pair = np.unique(doc * len(df) + sym)
    df += np.bincount(pair % len(df), minlength=len(df))
    latin = np.bincount(unit[ex.latin[sym]], minlength=len(flat))
    data = raw.tobytes()
    for k in np.flatnonzero((latin[unit] >= 2) & (sym == 0)).tolist():
        if _LATIN_END.fullmatch(data[start[k] : start[k] + size[k]].decode()):
            sym[k] = ex.mock
    known = sym > 0
    if (sym == ex.slot).any():
        # a separator's worth of room between units, so that none reaches into the next
        wide = np.zeros(len(sym) + (REACH + 1) * len(flat), np.int64)
        place = np.arange(len(sym)) + (REACH + 1) * unit
        wide[place] = sym
        known = known | _near_slots(wide, ex.slot)[place]
    total = np.bincount(unit, minlength=len(flat))
    known = np.bincount(unit[known], minlength=len(flat))
    pick = np.flatnonzero(_possible(known, total - known))
    first = np.searchsorted(unit, np.arange(len(flat) + 1))
    return df, [(owner[u], sym[first[u] : first[u + 1]].tolist()) for u in pick.tolist()]


def coverage(symbols: np.ndarray, weight: np.ndarray, ex: Exemplars) -> float:
    """Share of a unit's weight that lies in windows contained in the exemplars of a label it has a cue of."""
    w = weight[symbols]
    if not w.sum():
        return 0.0
    cued, thing = ex.cues(symbols, weight)
    labels = np.flatnonzero(cued)
    if not len(labels):
        return 0.0
    if thing and (symbols == 0).any():
        w[np.argmax(symbols == 0)] = 0.0
    size = min(WINDOW, len(symbols))
    sums = lambda x: np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    over = lambda s: s[size:] - s[:-size]
    inside = ex.has[symbols][:, labels]
    if "template" in ex.labels:
        inside = inside | (_near_slots(symbols, ex.slot)[:, None] & (labels == ex.labels.index("template")))
    good = np.flatnonzero((over(sums(inside * w[:, None])) >= CONTAINED * over(sums(w))[:, None] - 1e-9).any(axis=1))
    edge = np.zeros(len(symbols) + 1)
    np.add.at(edge, good, 1)
    np.add.at(edge, good + size, -1)
    covered = (np.cumsum(edge)[:-1] > 0) & inside.any(axis=1)
    return float((w * covered).sum() / w.sum())


def find_residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of documents of which the whole text or a unit is residue, each with its best coverage."""
    ship(docs.sparkSession)
    rows = docs.select(key, text).where(F.col(text).isNotNull())
    kind = rows.dtypes[0][1]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ex = Exemplars()
        df, seen = np.zeros(len(ex.lexicon.words) + 1, np.int64), 0
        shape = pa.schema([(key, arrow_key), ("symbols", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("n", pa.int64())])
        for batch in batches:
            for part in chunks_by_bytes(batch, text, CHUNK_BYTES):
                some, found = survey(part.column(text).to_pylist(), ex)
                df += some
                seen += part.num_rows
                if found:
                    keys = part.column(key).take(pa.array([k for k, _ in found]))
                    yield pa.record_batch([keys, pa.array([s for _, s in found], pa.list_(pa.int32())), pa.nulls(len(found), pa.list_(pa.int64())), pa.nulls(len(found), pa.int64())], schema=shape)
        yield pa.record_batch([pa.nulls(1, arrow_key), pa.nulls(1, pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([seen])], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_key = to_arrow_type(rows.schema[key].dataType)
    told = durable(rows.mapInArrow(first, f"`{key}` {kind}, symbols array<int>, df array<bigint>, n bigint"))
    counts = told.where("n is not null").select("n", F.posexplode("df").alias("s", "c")).groupBy("s").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    table = counts.collect()  # one row an exemplar word
    size = len(Exemplars().lexicon.words) + 1
    weight = np.zeros(size)
    for r in table:
        weight[r.s] = np.log1p(r.n / (1 + r.c))
    weight[Exemplars().trace] = weight.max()
    weight[0] = UNKNOWN * max(float(np.log1p(max([r.n for r in table], default=1))), float(weight[1:].max()))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ex = Exemplars()
        for batch in batches:
            score = [coverage(np.array(s), weight, ex) for s in batch.column("symbols").to_pylist()]
            yield pa.record_batch([batch.column(key), pa.array(score, pa.float64())], names=[key, "coverage"])

    scored = told.where("symbols is not null").select(key, "symbols").mapInArrow(second, f"`{key}` {kind}, coverage double")
    return scored.where(F.col("coverage") >= COVERED).groupBy(key).agg(F.max("coverage").alias("coverage"))
