from __future__ import annotations

import bisect
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import corpus, table, words
from pyspark.sql import functions as F

from inkveil.llm import bpe, common, jaccard_join, packing, quality, secrets, sharding, stages, substring_dedup, token_counts

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, ROWS).limit(0)


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = [t for _, t in ROWS]
    w = common.Words.of(pa.array(texts, pa.string()))
    expected = [x for t in texts for x in words(t)]
    assert [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends, strict=True)] == expected
    for which in (0, 1):
        seen: dict[int, bytes] = {}
        assert all(seen.setdefault(h, x) == x for h, x in zip(w.hashes(which).tolist(), expected, strict=True))
        assert len(seen) == len(set(expected))


def test_token_counts_and_cache(spark, docs, none, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = f"file://{tmp_path}/cache"
    expected = collections.Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in ROWS)
    for _ in range(2):  # the second run finds every count in the cache
        got = token_counts.count_tokens(docs, cache, path).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in ROWS})
    assert token_counts.count_tokens(none, f"file://{tmp_path}/empty", path).count() == 0


def test_cover_meets_every_shift():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [50, 7, 3])
def test_substring_dedup(docs, none, window):
    first: dict[tuple, int] = {}
    for i, t in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    expected = collections.Counter()
    for i, t in ROWS:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        expected[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    got = substring_dedup.dedup_substrings(docs, window).select("row.doc_id", "n_words", "n_removed", "kept_text").collect()
    assert collections.Counter(map(tuple, got)) == expected
    assert substring_dedup.dedup_substrings(none, window).count() == 0


def test_shards(spark, docs, none):
    got = sharding.balanced_shards(docs, 7).collect()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    share, largest = sum(r["size"] for r in got) / 7, max(r["size"] for r in got)
    for shard, rows in by.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and 0 <= shard < 7
        assert abs(sum(r["size"] for r in rows) - share) <= largest
    ids = [(-1 if r.doc_id is None else r.doc_id, r.shard) for r in got]
    assert [s for _, s in sorted(ids)] == sorted(s for _, s in ids)
    assert sharding.balanced_shards(none, 7).count() == 0


def test_bpe_words(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    expected = collections.Counter()
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expected[i, np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.encode_decode(docs, path).select("row.doc_id", "ids", "decoded").collect()
    assert collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == expected
    assert bpe.encode_decode(none, path).count() == 0


def test_bpe_of_zero_characters(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["ab \x00 cd", "\x00", "a\x00\x00b \x00"]
    got = bpe.encode_decode(table(spark, list(enumerate(texts))), path).select("row.doc_id", "ids").collect()
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got} == {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_secrets_and_ledger(spark, docs, none, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    for _ in range(2):
        got = secrets.scan_secrets(docs, ledger)
        assert got.count() == len(ROWS)
    assert spark.read.parquet(ledger).count() == len({t or "" for _, t in ROWS})
    row = got.where("row.doc_id = 64").select("secrets.*").first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 1)
    assert row.spans == "assign:0:20,access:21:41,hex:42:66" and row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
    assert secrets.scan_secrets(none, f"file://{tmp_path}/empty").count() == 0


@pytest.mark.parametrize(("text", "spans"), [("PassWord: 'hunter22'", [(0, 0, 19)]), ("token=abc", []), ("ſecret=abcdef", []), ("password=ab api_key=abcdefgh", [(12, 0, 28)]), ("AKIA" + "B" * 15, []), ("f" * 23, []), ("zz" + "a1" * 12 + "g", [(2, 2, 26)])])
def test_secret_rules(text, spans):
    assert secrets.find_secrets(text) == spans


KEY = "\n".join(["MIIEpAIBAAKCAQEA" + "aB3/" * 12] * 3 + ["Zk9+"])


@pytest.mark.parametrize("name", ["", "RSA ", "EC ", "ENCRYPTED "])
@pytest.mark.parametrize("end", [True, False])
def test_private_keys_are_hidden_whole(spark, name, end):
    head = "Proc-Type: 4,ENCRYPTED\n\n" if name == "RSA " else ""
    key = f"-----BEGIN {name}PRIVATE KEY-----\n{head}{KEY}" + (f"\n-----END {name}PRIVATE KEY-----" if end else "")
    text = f"before {key}\nafter the key"
    assert secrets.find_secrets(text)[0] == (7, 3, 7 + len(key))
    out = stages.masked_secrets(spark, table(spark, [(1, text), (2, key.replace("\n", "\\n") + " x")]), "").collect()
    assert {r.doc_id: r.text for r in out}[1] == "before [SECRET]\nafter the key"
    assert "MII" not in {r.doc_id: r.text for r in out}[2] and "aB3" not in {r.doc_id: r.text for r in out}[2]


def test_json_web_tokens_are_hidden(spark):
    out = stages.masked_secrets(spark, table(spark, [(1, "a eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4fw b")]), "").collect()
    assert [r.text for r in out] == ["a [SECRET] b"]


def brute_measures(text: str | None) -> tuple:
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n, covered = collections.Counter(grams), set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            covered |= set(range(k, k + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, none):
    more = [(70, "a b c d e " * 30), (71, "x#$ y%& z<> " * 20), (72, "same line\nsame line\nother line of words here to be long enough\n" * 3)]
    df = table(spark, ROWS + more)
    got = quality.judge(df).select("row.doc_id", "m.*", "base_failed", "kept").collect()
    expected = collections.Counter((i, *brute_measures(t)) for i, t in ROWS + more)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert not [r for r in got if r.doc_id in (70, 71) and r.kept]
    assert quality.judge(none).count() == 0


def test_em_finds_the_good_class():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.8
    right = np.array([0.9, 0.8, 0.85, 0.7])
    agree = rng.random((4000, 4)) < right
    votes = np.where(agree == truth[:, None], 1, -1) * (rng.random((4000, 4)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, good, bad = quality.fit(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.05 and (good[:, 2] > good[:, 0]).all() and (bad[:, 0] > bad[:, 2]).all()


def brute_components(rows, num, den, n):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return collections.Counter((i, len(sets[k]), (least.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("num", "den", "n"), [(90, 100, 3), (80, 100, 5), (60, 100, 1)])
def test_jaccard(spark, docs, none, num, den, n):
    got = jaccard_join.jaccard_components(docs, num, den, n).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(ROWS, num, den, n)
    if n == 3:
        assert jaccard_join.jaccard_components(none, num, den, n).count() == 0


def test_jaccard_small_sets(spark):
    import random

    rng = random.Random(5)
    rows = [(i, " ".join(sorted(rng.sample([f"t{k}" for k in range(24)], rng.randrange(17, 23))))) for i in range(60)]
    got = jaccard_join.jaccard_components(table(spark, rows), 90, 100, 1).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 90, 100, 1)


def test_light_boundary_by_cost():
    t = jaccard_join.Threshold(90, 100)
    assert jaccard_join.boundary({5: 100}, t) >= 5 and jaccard_join.boundary({}, t) == 0
    assert t.overlap(9, 10) == 9 and t.partners(10, 24)[0] == (9, 10, 9)


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    tok = Tokenizer.from_file(paths[0])
    got = packing.pack_documents(docs, *paths, capacity=256, with_ids=True).select("row.doc_id", "*").collect()
    expected = collections.Counter()
    for i, t in ROWS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 256 else len(ids) % 256 or 256
        for k, start in enumerate([0, *range(first, len(ids), 256)]):
            part = np.array(ids[start : first if not k else start + 256], "<u4").tobytes()
            expected[i, k, start, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(none, *paths).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps: list[int] = []
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, length)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else capacity) - length)
    return len(gaps)


@pytest.mark.parametrize("kind", ["even", "small", "exponential", "one length", "halves"])
def test_packing_takes_as_few_sequences_as_best_fit_decreasing(spark, kind):
    rng = np.random.default_rng(2)
    lengths = {
        "even": rng.integers(1, 257, 3000), "small": rng.integers(1, 30, 3000), "exponential": np.minimum(256, 1 + rng.exponential(40, 3000).astype(int)),
        "one length": np.full(500, 60), "halves": rng.choice([128, 129, 127, 256, 1], 900),
    }[kind].tolist()
    pieces = spark.createDataFrame(list(enumerate(lengths)), "tie long, length long").repartition(3)
    got = packing.pack_lengths(pieces, 256, common.Scratch(spark, "test")).collect()
    assert sorted((r.tie, r.length) for r in got) == list(enumerate(lengths))
    by = collections.defaultdict(list)
    for r in got:
        by[r.seq].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 256
    assert len(by) <= best_fit_decreasing(lengths, 256) * 1.005 + 1


def test_classes_cover_all_lengths():
    for capacity in (7, 64, 256, 1024, 1000):
        found = packing.classes(capacity)
        assert found[0][1] == capacity and found[-1][0] == 0 and all(a[0] == b[1] for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("top", [8, 1])
def test_jaccard_large_lists(spark, monkeypatch, top):
    """Lists of several chunks, a cluster wider than a star, documents that are mostly one shared passage."""
    import random

    monkeypatch.setattr(jaccard_join, "CHUNK_NODES", 16)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(120):
        near = list(base)
        for _ in range(rng.randrange(0, 6)):
            near[rng.randrange(len(near))] = f"e{rng.randrange(300)}"
        rows.append((i, " ".join(near)))
    rows += [(200 + i, " ".join([f"p{k}" for k in range(84)] + [f"u{i}x{k}" for k in range(16)])) for i in range(60)]
    rows += [(300 + i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 100))) for i in range(40)]  # a chain
    got = jaccard_join.jaccard_components(table(spark, rows), 90, 100, 1, top=top).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 90, 100, 1)


def test_sketches_bound_differences():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(1, 1 << 63, k, dtype=np.uint64)) for k in (3, 700, 5000, 9000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(1, 1 << 63, 5, dtype=np.uint64)])) for s in sets]
    with np.errstate(over="ignore"):
        own = jaccard_join.Sketches(jaccard_join.sketches(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets])))
    i, j = np.meshgrid(np.arange(8), np.arange(8))
    i, j = i.ravel(), j.ravel()
    differ = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    got = jaccard_join.apart(own, i, own, j)
    assert (got <= differ).all() and (got[differ == 0] == 0).all() and got[differ > 500].min() > 200


def test_hot_keys_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "n long, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("other", 4)], "key string, v int")
    hot = common.hot_keys(left, "key")
    assert hot == ["hot"] and common.hot_keys(left.limit(0), "key") == []
    for keys in (hot, []):
        got = collections.Counter(map(tuple, common.join_each(left, right, "key", keys).select("n", "key", "v").collect()))
        assert got == collections.Counter([(i, "hot", 1) for i in range(60) if i % 3] + [(0, "k0", 2), (3, "k3", 3)])


def brute_spans(text):
    """Base spans by plain patterns."""
    import regex

    out = []
    for kind, pattern, least in (("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)):
        order = ("assign", "access", "hex").index(kind)
        for m in regex.finditer(pattern, text, regex.ASCII):
            if len(m[1]) >= least:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secret_spans_against_plain_patterns(spark, tmp_path):
    import random

    rng = random.Random(6)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "apiKey", ":", "=", " = ", "'", '"', " ", "\n", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef", "0123456789abcdef", "abc", "é", "x9/+", "日本", "-----"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(400)] + list(ROWS)
    got = secrets.scan_secrets(table(spark, rows), f"file://{tmp_path}/l").select("row.doc_id", "row.text", "secrets.*").collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute_spans(r.text or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k + ":") for k in ("assign", "access", "hex"))


def test_quality_verdicts_follow_from_the_votes(spark):
    """kept: the posterior of EM over the votes of all documents, computed plainly."""
    rows = [(i, t) for i, t in ROWS if t] + [(100 + i, "\n".join(" ".join(f"word{k * 9 + j}" for j in range(9)) for k in range(6))) for i in range(40)] + [(200 + i, "#$% &&| <> ## " * 30 + "x" * i) for i in range(12)]
    got = quality.judge(table(spark, rows), carry=["doc_id"]).collect()
    votes = collections.Counter()
    seen = {}
    for r in got:
        m = r.m
        n, chars = m.n_words, m.word_chars
        v = (
            -1 if m.n_repeat_words * 100 > n * 20 else 1 if m.n_repeat_words * 100 <= n * 5 else 0, -1 if m.n_symbols * 100 > chars * 8 else 1 if m.n_symbols * 100 <= chars * 2 else 0,
            -1 if m.n_dup_lines * 100 > m.n_lines * 30 else 1 if m.n_lines > 1 and m.n_dup_lines * 10 <= m.n_lines else 0, -1 if chars > n * 20 or chars < n * 2 else 1 if n * 3 <= chars <= n * 12 else 0,
            -1 if m.n_symbol_words * 100 > n * 25 else 1 if m.n_symbol_words * 100 <= n * 10 else 0, -1 if n < 10 else 1 if n >= 20 else 0,
        )
        votes[v] += 1
        seen[r.row.doc_id, r.m] = v
    patterns = sorted(votes)
    prior, good, bad = quality.fit(np.array(patterns), np.array([votes[p] for p in patterns], float))
    for r in got:
        odds = np.log(prior / (1 - prior)) + sum(np.log(good[k][x + 1] / bad[k][x + 1]) for k, x in enumerate(seen[r.row.doc_id, r.m]))
        assert abs(r.p_good - 1 / (1 + np.exp(-odds))) < 1e-9 and r.kept == (not r.base_failed and r.p_good >= 0.5)
    kept = {r.row.doc_id for r in got if r.kept}
    assert kept >= set(range(100, 140)) and not kept & set(range(200, 212))
