from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gyrolith.llm import queries
from gyrolith.llm.bpe import Encoder, encode_corpus
from gyrolith.llm.cells import units
from gyrolith.llm.fmindex import FMIndex
from gyrolith.llm.hashing import HashTable
from gyrolith.llm.leaks import leaked_spans, leaks_in, phrases_of
from gyrolith.llm.nearest import XFastTrie, match_nearest
from gyrolith.llm.residue import COVERED, SLOT, UNKNOWN, Exemplars, _possible, canonical, coverage, find_residue
from tests.llm import heldout
from gyrolith.llm.runs import collapse_runs
from gyrolith.llm.visible import visible
from tests.oracle import check

VOCAB = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.QUERIES[name], queries.ORACLE[name])


# ---- nearest time
def test_hash_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 5000))
    t = HashTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(np.setdiff1d(rng.integers(0, 1 << 62, 3000), keys)) == -1).all()


def test_trie_neighbours_against_search():
    rng = np.random.default_rng(1)
    bits = 9
    leaves = np.unique((rng.integers(0, 4, 300) * 2 << bits) | rng.integers(0, 1 << bits, 300))
    q = (rng.integers(0, 9, 3000) << bits) | rng.integers(0, 1 << bits, 3000)
    before, after = XFastTrie(leaves, bits).neighbours(q)
    for k, b, a in zip(q.tolist(), before.tolist(), after.tolist()):
        mine = [x for x in leaves.tolist() if x >> bits == k >> bits]
        lo, hi = [x for x in mine if x <= k], [x for x in mine if x >= k]
        assert (leaves[b] if b >= 0 else None) == (max(lo) if lo else None)
        assert (leaves[a] if a >= 0 else None) == (min(hi) if hi else None)


def test_nearest_against_brute_force_with_nulls_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    base = pd.DataFrame({"e": rng.choice(["a", "b", "c"], 400), "t": rng.uniform(-5, 20, 400).round(3), "k": np.arange(400)})
    ask = pd.DataFrame({"e": rng.choice(["a", "b", "d"], 300), "t": rng.uniform(-5, 20, 300).round(4), "j": np.arange(300)})
    base.loc[::17, "t"] = np.nan
    ask.loc[3, "t"] = np.nan
    b, q = spark.createDataFrame(pd.concat([base, base[:50]])), spark.createDataFrame(pd.concat([ask, ask[:40]]))
    got = {(r.e, r.j): r.k for r in match_nearest(q, b, ["e"], "t", "j", "t", "k", 0.05, shard=1.0).collect()}
    want = {}
    for r in ask.dropna().itertuples():
        m = base[(base.e == r.e) & base.t.notna()]
        d = (m.t - r.t).abs()
        if len(d) and d.min() <= 0.05:
            best = m[d == d.min()].sort_values(["t", "k"]).iloc[0]
            want[(r.e, r.j)] = best.k
    assert got == want
    assert match_nearest(q.limit(0), b, ["e"], "t", "j", "t", "k", 0.05).count() == 0
    assert match_nearest(q, b.limit(0), ["e"], "t", "j", "t", "k", 0.05).count() == 0


# ---- runs
def test_runs_across_shards(spark):
    rows = [("a", k * 0.5, k, [1.0, 0.0] if k // 7 % 2 else [-1.0 if k % 2 else 1.0, 0.0]) for k in range(40)]
    rows += [("a", 100.0, 50, [0.0, 0.0]), ("a", None, 51, [1.0, 0.0]), ("a", 19.75, 52, [float("nan"), 0.0]), ("b", 3.0, 1, [1.0, 2.0]), (None, 1.0, 1, [1.0, 0.0])]
    df = spark.createDataFrame([(e, t, i, q[0], q[1], "x") for e, t, i, q in rows + rows[:5]], "e string, t double, i bigint, x double, y double, n string")
    for shard in (0.6, 1000.0):
        got = sorted((r.e, r.first_idx, r.last_idx, r.n, r.duration) for r in collapse_runs(df, ["e"], "t", "i", ["x", "y"], shard=shard).collect())
        assert got == [("a", 0, 39, 40, 19.5), ("b", 1, 1, 1, 0.0)]
        alone = collapse_runs(df, ["e"], "t", "i", ["x", "y"], sign_free=False, shard=shard).where("e = 'a' and n > 1").collect()
        assert {(r.first_idx, r.last_idx) for r in alone} >= {(6, 14)}
    assert collapse_runs(df.limit(0), ["e"], "t", "i", ["x", "y"]).count() == 0


# ---- encoding
@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")
def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(VOCAB)
    lib.encode_special_tokens = True
    rng = np.random.default_rng(3)
    bits = ["'s", "'", "s", "re", "'re", "'ll", " ", "  ", "\n", "\t", "a", "Bc", "12", "é", "中", " ", "　", "!", "?!", "\x85", "\x1c", "<|endoftext|>", "́", "²", "😀", "\r\n", "​"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 15))) for _ in range(3000)]
    texts += ["a" * 4000, " " * 3000, "ab" * 3000, "", "=-" * 2000, "x" * 300_000]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(VOCAB).encode(pa.array(texts)).to_pylist() == want
    some = texts[:200] + [None, ""]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in encode_corpus(df, VOCAB).collect()}
    assert got == {k: (want[k] if k < 200 else []) for k in range(len(some))}


# ---- leaks
def test_fm_index_against_scan():
    rng = np.random.default_rng(4)
    for top in (2, 5, 40):
        seq = rng.integers(1, top + 1, 400)
        seq[rng.integers(0, 399, 12)] = 0
        seq[-1] = 0
        pats = np.stack([seq[k : k + 3] for k in range(0, 390, 7)] + [rng.integers(1, top + 1, 3) for _ in range(20)])
        pats = pats[(pats > 0).all(axis=1)]
        ix = FMIndex(seq, top)
        lo, hi = ix.search(pats)
        for p, a, b in zip(pats, lo, hi):
            want = [k for k in range(len(seq) - 2) if (seq[k : k + 3] == p).all()]
            assert sorted(ix.locate(np.arange(a, b)).tolist()) == want


ITEM = "In the town of Vornshabex there are 13 crystal gates, of which Kevlotane keeps 23 shut until Vornshabex rings every single evening."


def disguised(text):
    w = text.split()
    yield text.upper()
    yield "\n".join(f"# {x}" for x in w)
    yield " ".join(f"<b>{x}</b>" for x in w)
    yield "&nbsp;".join(w)
    yield " ".join(f"**{x}**" if k % 2 else f"_{x}_" for k, x in enumerate(w))
    yield '"' + '\\n",\n "'.join(w) + '"'
    yield " ".join(x[:2] + "​" + x[2:] for x in w)
    yield text.translate({c: c + 0xFEE0 for c in range(0x30, 0x7B)}).replace(" ", "　")
    yield "\x1b[31m" + "\x1b[0m ".join(w)
    yield " ".join("".join(f"\\u{ord(c):04x}" for c in x) for x in w)


def test_leaks_in_disguise_and_short_ones(spark):
    words = ITEM.split()
    docs = [(k, f"before {t} after") for k, t in enumerate(disguised(ITEM))]
    docs += [(100, " ".join(words[:11])), (101, " ".join(words[:11]) + " x " + " ".join(words[11:])), (102, None), (103, ""), (104, " ".join(words[5:17])), (105, " ".join(words[:12]) + " other " + ITEM)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None)], "item_id bigint, text string")
    got = leaked_spans(df, items).collect()
    assert {r.doc_id for r in got} == {*range(10), 104, 105} and {r.item_id for r in got} == {7}
    assert sorted((r.first_word, r.n_words) for r in got if r.doc_id == 105) == [(0, 12), (13, len(words))]


def test_leaks_against_brute_force():
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(6)]
    items = [(k, " ".join(rng.choice(vocab, 8))) for k in range(5)]
    texts = [" ".join(rng.choice([*vocab, "zz"], 300)) for _ in range(20)]
    where, item, _, _ = leaks_in(texts, phrases_of(items, 4))
    want = set()
    for d, t in enumerate(texts):
        for k, i in items:
            g = i.split()
            if any(f" {' '.join(g[j : j + 4])} " in f" {t} " for j in range(len(g) - 3)):
                want.add((d, k))
    assert set(zip(where.tolist(), item.tolist())) == want


def test_leaks_in_a_corpus_without_any_word_of_the_items(spark):
    df = spark.createDataFrame([(1, "nothing shared here")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    assert leaked_spans(df, items).collect() == []


def test_leaks_of_many_blocks_of_items_equal_those_of_one(spark, monkeypatch):
    rng = np.random.default_rng(12)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocabulary, 20))) for k in range(30)] + [(99, None)]
    docs = [(k, " ".join([*rng.choice(vocabulary, 5), *items[k % 30][1].split()[2 : 14 + k % 3]])) for k in range(60)] + [(60, None), (61, "")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, leaked_spans(d, i).collect()))
    monkeypatch.setattr("gyrolith.llm.leaks.ITEM_BLOCK_CHARS", 300)
    assert one and sorted(map(tuple, leaked_spans(d, i).collect())) == one


def test_visible_leaves_plain_text():
    assert visible("a < b and c > d") == "a < b and c > d" and visible("ÄRGER ﬁt").split() == ["ärger", "fit"]


def test_long_tags_are_no_words():
    data = "iVBORw0KGgo/AAA+" * 1000
    assert visible(f'one <img alt="x" src="data:image/png;base64,{data}"> two').split() == ["one", "two"]
    assert visible(f"on<span title='{data}'>e</span> two").split() == ["one", "two"]
    prose = "words " * 500
    assert visible(f"if x <p and {prose}> y").split()[-2:] == [">", "y"]


# ---- residue
BOOK = '{"cells": [{"cell_type": "markdown", "source": ["# Title\\n"]}, {"cell_type": "code", "source": ["x = 1"], "outputs": [{"text": ["out\\n"]}]}]}'


def test_units_of_each_flattening():
    assert units(BOOK) == ["# Title\n", "out\n"]
    assert units(BOOK[:-60])[0] == "# Title\n"
    assert [u.strip() for u in units("# %% [markdown]\n# Text\n\n# %%\ncode()\n\n# + output\n#   12")][1:] == ["Text", "12"]
    assert [u.strip() for u in units("Text\n\n```python\ncode()\n```\n\n```text\n12\n```\n")][1:] == ["Text", "12"]
    assert [u.strip() for u in units("Text\n\nIn [1]:\ncode()\n\nOut[1]:\n12")][1:] == ["Text", "12"]
    assert units("﻿") == [] and units("") == []


def test_long_placeholders():
    long = "the_full_name_of_the_author_of_this_notebook_and_of_its_reviewers_as_registered"
    for t in (f"{{{{ {long} }}}}", f"<Your {long}>", f"[{long.upper()}]", f"%%{long}%%", f"{{{long}}}"):
        assert canonical(f"By {t}.").split() == ["By", SLOT, "."]


def test_residue_in_unseen_wordings(spark, sf_dir):
    """Each set was written after the exemplars it tests; README gives the figures it had then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 100000 as doc_id", "text")
    sets = [(heldout.RESIDUE, heldout.CONTENT), (heldout.RESIDUE_2, heldout.CONTENT_2), (heldout.RESIDUE_3, heldout.CONTENT_3)]
    rows = [(1000 * k + i, t, i < len(yes)) for k, (yes, no) in enumerate(sets) for i, t in enumerate(yes + no)]
    df = docs.unionByName(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"))
    found = {r.doc_id for r in find_residue(df).where("doc_id < 100000").collect()}
    for k in range(len(sets)):
        yes = {i for i, _, y in rows if i // 1000 == k and y}
        hit = {i for i in found if i // 1000 == k}
        assert len(hit & yes) >= 0.9 * len(yes) and len(hit & yes) >= 0.9 * len(hit)


def test_what_the_first_pass_leaves_out_could_not_be_covered():
    rng = np.random.default_rng(3)
    ex = Exemplars()
    for _ in range(300):
        known, unknown = int(rng.integers(1, 12)), int(rng.integers(0, 12))
        sym = rng.permutation(np.r_[rng.integers(1, len(ex.lexicon.words) + 1, known), np.zeros(unknown, int)])
        weight = rng.uniform(0.1, 9, len(ex.lexicon.words) + 1)
        weight[0] = UNKNOWN * weight[1:].max()
        if not _possible(np.array([known]), np.array([unknown]))[0] and not (sym == ex.slot).any():
            assert coverage(sym, weight, ex) < COVERED


def test_residue_and_what_only_speaks_of_it(spark):
    prose = " We smooth the noisy panel twice, then compare sensor 4 with engine 7 and keep the rest for later."
    yes = ["You need to enable JavaScript to run this notebook.", "Prepared by {{ author }} on <DATE>.", "# Data\n\nLorem ipsum dolor sit amet vela.\n\nIn [1]:\nx", "403 : Forbidden\n\nWe could not fetch this notebook. Try again later.\nRequest e352951277e2", '{"message": "Not Found", "status": 404, "request_id": "24108fbff91d"}', "<html><head><title>502 Bad Gateway</title></head><body><h1>Bad Gateway</h1><p>The path /a/b.ipynb was not served.</p><hr>gauged/3.2</body></html>", "xxxx xxxx xxxx"]
    no = ["The fetcher sees a short page asking readers to enable JavaScript, so we wait." + prose, "Anything between `{{` and `}}` is looked up." + prose, "HTTPError: HTTP Error 404: Not Found", None, "", "  ", "12 13 14", "# Loading the valve", "In [1]:\nhtml = fetch(url)\n'enable JavaScript' in html\n\nOut[1]:\nTrue"]
    filler = [f"{prose} {k}" for k in range(60)]
    rows = list(enumerate(yes + no + filler))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in find_residue(df).collect()} == set(range(len(yes)))
    assert find_residue(df.limit(0)).count() == 0
