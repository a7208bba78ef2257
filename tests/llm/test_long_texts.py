"""One very long text, its copy, and short texts, through the operators that work on whole texts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import table, words

from inkveil.llm import bpe, packing, quality, secrets, sharding, substring_dedup, token_counts

MILLIONS = 10


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    line = lambda: " ".join(f"{rng.choice(['alpha', 'Beta', 'né', 'x'])}{rng.randrange(10**6)}" for _ in range(12))
    passage = " ".join(f"p{i}" for i in range(60))
    long = "\n".join(line() for _ in range(MILLIONS * 1_000_000 // 125))
    long += f"\n{passage}\ntoken = abc123secret"
    return {1: long, 2: long, 3: f"start {passage} end", 4: "short"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, list(texts.items())).repartition(4)


def test_tokens(docs, texts, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    known = {t: len(sp.encode(t)) for t in set(texts.values())}
    got = token_counts.count_tokens(docs, f"file://{tmp_path}/cache", path).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len(t.encode()), known[t]) for i, t in texts.items()}


def test_substrings(docs, texts):
    got = substring_dedup.dedup_substrings(docs).select("row.doc_id", "n_words", "n_removed").collect()
    n = len(words(texts[1]))
    assert sorted(map(tuple, got)) == [(1, n, 0), (2, n, n), (3, 62, 60), (4, 1, 0)]


def test_shards_secrets_and_rules(docs, texts, tmp_path):
    got = sharding.balanced_shards(docs, 3).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    n = len(texts[1])
    found = secrets.scan_secrets(docs, f"file://{tmp_path}/ledger").select("row.doc_id", "secrets.spans").collect()
    assert {r.doc_id: r.spans for r in found} == {1: f"assign:{n - 20}:{n}", 2: f"assign:{n - 20}:{n}", 3: "", 4: ""}
    rows = quality.judge(docs, carry=["doc_id"]).select("row.doc_id", "m.n_words", "m.word_chars", "m.n_dup_lines").collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: (len(t.split()), sum(map(len, t.split())), 0) for i, t in texts.items()}


def test_encoding(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {}
    for t in set(texts.values()):
        ids = tok.encode(t, add_special_tokens=False).ids
        want[t] = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), tok.decode(ids, skip_special_tokens=False)
    got = bpe.encode_decode(docs, path).select("row.doc_id", "ids", "decoded").collect()
    assert {r.doc_id: (hashlib.sha256(bytes(r.ids)).hexdigest(), r.decoded) for r in got} == {i: want[t] for i, t in texts.items()}


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known = {t: len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in set(texts.values())}
    got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), carry=["doc_id"])
    pieces = got.select("row.doc_id", "piece", "start", "length").orderBy("piece").collect()
    for i in texts:
        rows = [r for r in pieces if r.doc_id == i]
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == known[texts[i]]
        assert all(b.start == a.start + a.length for a, b in zip(rows, rows[1:], strict=False)) and all(r.length <= 1024 for r in rows)
