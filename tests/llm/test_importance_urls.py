from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, table

from inkveil.llm import importance, url_filter

ROWS = corpus(3)
TARGET = [(0, "w1 w2 w3 w4 w4 One TWO"), (1, None), (2, ""), (3, "é日本 w7-w8 W9")]
CLASHING = "doc_id long, text string, id string, tie int, part int, score string, rank int, n_words string, row string, weight int"


def feature_list(text, longest):
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, longest, buckets, least, share, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for _, x in part for f in feature_list(x, longest)[1]) for part in (rows, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        w, f = feature_list(text, longest)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * share[0] // share[1]]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("longest, buckets, least, share", [(1, 10_000, 20, (10, 100)), (3, 97, 0, (1, 2)), (2, 5, 30, (1, 1))])
def test_resampling_is_as_brute_force(spark, longest, buckets, least, share):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, "s", 3, "n", "r", 4) for i, t in ROWS], CLASHING).repartition(5)
    got = importance.resample(docs, table(spark, TARGET), share, longest, buckets, least, 7).collect()
    found = [(r.row.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got]
    expected = [tuple(r) for r in brute(ROWS, TARGET, longest, buckets, least, share, 7)]
    assert collections.Counter(x[:5] for x in found) == collections.Counter(x[:5] for x in expected)
    assert sorted((x[5], x[4], x[0] or -1) for x in found if x[5]) == sorted((x[5], x[4], x[0] or -1) for x in expected if x[5])
    assert got[0].row.asDict().keys() == set(docs.columns)


def test_resampling_of_empty_tables(spark):
    docs, none = table(spark, ROWS), table(spark, ROWS).limit(0)
    assert importance.resample(none, docs).count() == 0
    assert importance.resample(docs, none).count() == len(ROWS)


def test_crcs_of_long_words_and_of_texts_side_by_side():
    texts = ["a" * 63, "b" * 64, "c" * 65 + " d", None, "", "é" * 40, "x" * 3_000_000, "y", "Zz9", "-", "ab-cd"]
    bucket, doc, n = importance.features(pa.array(texts, pa.string()), 1, 1 << 31)
    w = [(i, x) for i, t in enumerate(texts) for x in feature_list(t, 1)[0]]
    assert doc.tolist() == [i for i, _ in w] and n.tolist() == [len(feature_list(t, 1)[0]) for t in texts]
    assert bucket.tolist() == [zlib.crc32(x.encode()) % (1 << 31) for _, x in w]


def test_a_very_long_text(spark):
    text = "word " * 10_000_000  # 50 MB
    got = importance.resample(table(spark, [(1, text), (2, "word other")]), table(spark, TARGET), (1, 1)).collect()
    assert {(r.row.doc_id, r.n_features, r.rank) for r in got} == {(1, 10_000_000, 1), (2, 2, None)}


URLS = "page_id long, url string, html string, host string, path string, blocked int, features string, suffix int, label int, won string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", "y", 1, "z", 1, 2, "w") for i, u in urls], URLS)


def brute_rule(url, rules):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(-len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, *(min(fit)[1:] if fit else (None, None)))


def test_url_rules_on_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x", "http://a.example.org/es", "http://example.org/en/1?x=/", "http://badexample.org/en/12#z", "https://é.COM/fr/", "http://com/de/1",
            "x://y.com/de/?http://z.org/", "http://a.org", "http://org/", "a\nb://c.com/fr/\nq", "http://h.com?/de/", "http://u@org:80/", "http://example.org/en/2", "http://a.com/de/x", "http://a.com/de/x"]
    got = url_filter.judge_urls(pages(spark, enumerate(urls)), url_filter.RULES).collect()
    for r in got:
        host, path, rule, verdict = brute_rule(urls[r.row.page_id], url_filter.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.row.page_id]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert r.by_rule == (verdict is not None)
    assert len(got) == len(urls) and url_filter.judge_urls(pages(spark, []), url_filter.RULES).count() == 0


def test_url_rules_of_one_kind_leave_no_trees(spark):
    urls = pages(spark, [(1, "http://a.org/x"), (2, "http://b.net/y"), (None, None)])
    assert {r.verdict for r in url_filter.judge_urls(urls, [("allow", "org/")]).collect()} == {"allow"}
    assert {r.verdict for r in url_filter.judge_urls(urls, [("block", "org/")]).collect()} == {"block"}
    assert {r.verdict for r in url_filter.judge_urls(urls, []).collect()} == {"allow"}


def made_urls(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        if rng.random() < 0.4:
            out.append((f"http://{''.join(rng.choices('abcdef0123456789', k=rng.randrange(8, 25)))}.{rng.choice(['info', 'biz', 'com'])}/{'/'.join(str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 5)))}?" + "&".join(f"p{k}={rng.random()}" for k in range(rng.randrange(5))), 1))
        else:
            out.append((f"https://www.{rng.choice(['news', 'garden', 'museum', 'school'])}{rng.choice(['', 's', '-online'])}.{rng.choice(['org', 'net', 'com'])}/{rng.choice(['about', 'articles/today', 'en/index.html', ''])}", 0))
    return out


def test_trees_judge_held_out_urls(spark):
    model = url_filter.fit(spark.createDataFrame(made_urls(1, 2000), "url string, blocked int"))
    held = spark.createDataFrame(made_urls(2, 1000), "url string, blocked int")
    host, path = url_filter.host_and_path(held.url)
    got = model.blocked(url_filter.lexical(held.select("url", host.alias("host"), path.alias("path"), held.blocked.alias("truth")))).select("truth", "blocked").collect()
    assert np.mean([bool(r.truth) == r.blocked for r in got]) > 0.97
    again = url_filter.fit(spark.createDataFrame(made_urls(1, 2000)[::-1], "url string, blocked int").repartition(7))
    assert again.trees.toDebugString.split("\n")[1:] == model.trees.toDebugString.split("\n")[1:]
