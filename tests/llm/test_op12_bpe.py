"""Encoding against the tokenizer library, decoding as an exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from surv.llm import bpe
from tests.conftest import SF_SMALL
from tests.llm.fixtures import SCHEMA, clash, make_docs

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
OTHER = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own(encoder, text):
    return [x for p in regex.findall(P.PATTERN, text) for x in encoder.encode_piece(p.encode())]


@pytest.mark.parametrize("ranks", [RANKS, OTHER])
@pytest.mark.parametrize("leaf", [1, 2, 16])
def test_texts_as_the_library(monkeypatch, ranks, leaf):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    encoder, tk, r = bpe.Encoder(ranks), library(ranks), random.Random(leaf)
    for alphabet in ("aA b", "abcdefgh", "a", "ab", " \n\t", "é中😀‍", "0123456789", "!-=#", "ththehean", "'st 're"):
        for n in (0, 1, 2, 7, 33, 200, 900):
            t = "".join(r.choice(alphabet) for _ in range(n))
            assert own(encoder, t) == tk.encode_ordinary(t)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(t):
    assert own(bpe.Encoder(RANKS), t) == library(RANKS).encode_ordinary(t)


@pytest.mark.parametrize("t", ["a" * 300_000, "ab" * 100_000, "abc" * 60_000, " " * 200_000, "中" * 60_000, "=-" * 100_000])
def test_one_very_long_piece(t):
    encoder = bpe.Encoder(RANKS)
    ids = own(encoder, t)
    assert ids == library(RANKS).encode_ordinary(t) and encoder.decode(ids) == t.encode()


def test_product_does_not_depend_on_the_cut():
    r, encoder = random.Random(4), bpe.Encoder(RANKS)
    for _ in range(300):
        data = "".join(r.choice(["tion", "th", "é", "x", "an", "aaa"]) for _ in range(r.randint(2, 40))).encode()
        cut = r.randrange(len(data) + 1)
        assert encoder.join(encoder.encode(data[:cut]), encoder.encode(data[cut:])) == encoder.encode(data)
        assert encoder.encode(data).tolist() == encoder.merge(data) == encoder.merge_long(data)


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder(RANKS)
    for i in range(100):
        assert encoder.decode(np.frombuffer(encoder.pieces[f"w{i}x"], "<u4").tolist()) == f"w{i}x".encode()
    assert len(encoder.pieces) <= 10 and len(encoder.apart) <= 10


def test_awkward_rows_and_clashing_columns(spark):
    docs = clash(spark.createDataFrame(make_docs() + [(900, "tail \x00 ﻿ \r\n", None, None), (901, "z" * 50_000, None, None)], SCHEMA))
    docs = docs.selectExpr("*", "'mine' AS ids", "'mine' AS c0")
    out = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    assert set(out.columns) == set(docs.columns) | {"ids", "decoded"}
    rows, tk = out.collect(), library(RANKS)
    assert len(rows) == docs.count()
    for x in rows:
        assert np.frombuffer(bytes(x.ids), "<u4").tolist() == tk.encode_ordinary(x.text or "") and bytes(x.decoded) == (x.text or "").encode()
        assert x["a.b"] == "extra" and x.c0 == "mine"
    assert bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in E.queries()["op12_byte_bpe"](spark, SF_SMALL).collect()}
    docs, tk = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect(), library(RANKS)
    assert len(got) == len(docs)
    for d in docs:
        ids, r = np.array(tk.encode_ordinary(d.text or ""), "<u4"), got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
