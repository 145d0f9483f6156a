"""Ranked search, URL filters and whitening against brute force on small fixtures with odd rows."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.llm import ranked_search, url_filter, whitening
from tests.llm.test_text_operators import ROWS, found, frame

EXTRA = ("m", "n", "segment", "docs", "query", "rank", "score", "x", "v", "host", "path", "rule", "verdict", "size")


def clashing(df):
    return df.withColumns({c: F.lit("y") for c in EXTRA if c not in df.columns})


# ---------------------------------------------------------------- 11 ranked search

def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]


def brute_search(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, w, Counter(w)) for i, w in own if w]
    n, length = len(own), sum(len(w) for _, w, _ in own)
    df = Counter(t for _, _, c in own for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in queries.items():
        rows = []
        for i, w, c in own:
            m = 100 - 90 + 90 * len(w) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in wanted if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(i, t) for i, (_, t) in enumerate(ROWS[:25])] + [
    (100, None), (101, ""), (102, "unheard-of"), (None, "changed é"), (7, "one TWO"), (8, "long"), (8, "long"), (9, "a b c d é x 😀")]


@pytest.mark.parametrize("limits", [{}, {"SEGMENT_POSTINGS": 40, "GROUP_POSTINGS": 90, "BLOCK_TERMS": 50, "SEEDS": 1}])
def test_search_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked_search, name, value)
    items = clashing(spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = found(ranked_search.search(frame(spark, ROWS), items, 4))
    assert got == brute_search(ROWS, ITEMS, 4)
    assert len({r[0] for r in got}) > 20


def test_search_ties_take_the_smallest_ids_across_segments(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", 3)
    docs = [(i, "same words here") for i in range(200, 0, -1)] + [(1000 + i, f"other text {i}") for i in range(300)]
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = found(ranked_search.search(frame(spark, docs, 7), items, 10))
    assert got == brute_search(docs, [(1, "words")], 10)
    assert sorted(r[2] for r in got) == list(range(1, 11))


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(ranked_search.search(none, items)) == []
    assert found(ranked_search.search(frame(spark, ROWS), items.filter("item_id is null"))) == []


def test_index_is_kept_for_several_searches_and_deleted(spark):
    index = ranked_search.Index.build(frame(spark, ROWS))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(index.search(items, 2)) == brute_search(ROWS, ITEMS, 2)
    assert found(index.search(items, 1)) == brute_search(ROWS, ITEMS, 1)
    bounds = index.segments.select("m", "n_postings").collect()
    assert len({r.m for r in bounds}) > 5 and all(r.n_postings > 0 for r in bounds)
    index.release()
    with pytest.raises(Exception):
        spark.read.parquet(*index.segments.inputFiles())


# ---------------------------------------------------------------- 12 URL filters

URLS = [None, "", "no scheme casino", "http://", "http://A.COM", "http://a.com/", "https://www.Example.com/en/1?x=/fr/#t", "http://example.com/en/",
        "http://m.www.example.com/en/x", "http://xexample.com/en/", "http://example.com/en", "http://b.net/es/1", "http://b.net/fr/", "http://b.net/de/",
        "http://net/es/", "http://m.casino.example.org/de/1", "http://m.casinos2.example.org/", "http://spam-farm.example.org/a", "http://spam.spam.org/",
        "http://spamfarm.example.org/", "http://x.org/free?win#poker", "http://x.org/éfree/win", "ftp://u:p@h.org:80?q", "http://x.net#a?b/c", "http://é.COM/Ü",
        "http://x.org/CASINO", "a://b://c/d", "http://x.org/webcam-sex", "http://x.org/" + "free-" * 50000]


def brute_verdict(url):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    apart = lambda t: re.search("(?<![a-z0-9\x80-\U0010ffff])" + re.escape(t) + "(?![a-z0-9\x80-\U0010ffff])", low)
    strict, soft = sum(bool(apart(t)) for t in url_filter.STRICT), sum(bool(apart(t)) for t in url_filter.SOFT)
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if strict or soft >= 2 else "allow"


def test_urls_equal_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[7]), (3, URLS[7]), (3, URLS[7])]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string").repartition(3))
    got = found(url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict"))
    assert got == sorted([(i, *brute_verdict(u)) for i, u in rows], key=repr)
    assert {r[4] for r in got} == {"allow", "block"} and {r[3] for r in got} >= {None, "com/", "net/es/", "www.example.com/en/"}
    kept = url_filter.keep_allowed(pages)
    assert kept.columns == pages.columns
    assert sorted(map(repr, (r.url for r in kept.collect()))) == sorted(repr(u) for _, u in rows if brute_verdict(u)[3] == "allow")


def test_url_policy_of_a_user(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y"), (2, "http://b.c/x"), (3, "http://q/bad"), (4, "http://q/mild-mild-soft")],
                                  "page_id long, url string")
    policy = url_filter.UrlPolicy(rules=(("block", "b.c", ""), ("allow", "b.c", "/x/"), ("block", "b.c", "/x/")), strict=("bad",),
                                  soft=(("mild", 1), ("soft", 2)), limit=3)
    got = {r.page_id: (r.rule, r.verdict, r.weight, r.n_strict, r.n_soft, r.hits) for r in url_filter.judge(pages, policy).collect()}
    assert got == {1: ("b.c/x/", "allow", 0, 0, 0, ""), 2: ("b.c", "block", 0, 0, 0, ""), 3: (None, "block", 3, 1, 0, "bad"),
                   4: (None, "block", 3, 0, 2, "mild,soft")}
    nothing = url_filter.UrlPolicy(rules=(), strict=(), soft=())
    assert {r.verdict for r in url_filter.judge(pages, nothing).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 13 whitening

def integers(v):
    return tuple(math.floor(64 * c) + 1000000 for c in v)


def check_whitening(spark, rows, components=16, exact=True):
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    got = whitening.whiten(table, components).collect()
    kept = [(i, integers(np.array(v, np.float32).astype(float))) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    size = Counter(len(x) for x in {x for _, x in kept}).most_common(1)[0][0]
    kept = [(i, x) for i, x in kept if len(x) == size]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = [Fraction(s, n) for s in sums]
    v = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(size)] for i in range(size)]
    e, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    order = np.argsort(-e)[:components]
    e, axes = e[order], axes[:, order]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == len(kept) * len(order)
    assert {r.n for r in got} == {n}
    trace = sum(float(v[i][i]) for i in range(size))
    for i, x in kept:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        own = [r for r in by[i] if r.deviation == (dev if dev < 2 ** 63 else None)]
        assert {r.component for r in own} == set(range(1, len(order) + 1))
        centred = np.array([float(Fraction(c) - a) for c, a in zip(x, mean)])
        for r in own:
            k = r.component - 1
            if e[k] > 1e-9 * e[0]:
                assert abs(abs(r.whitened) - abs(centred @ axes[:, k]) / math.sqrt(e[k])) < 1e-6 or not exact or len(by[i]) > len(order)
                assert abs(r.explained - e[k] / trace) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    return got


def vectors(seed, n, size, spread=None):
    rng = np.random.default_rng(seed)
    scale = np.array(spread if spread is not None else rng.uniform(0.2, 3, size))
    return [(i, (rng.normal(size=size) * scale).astype(np.float32).tolist()) for i in range(n)]


ODD = [(None, [0.5] * 6), (900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [math.nan] + [0.0] * 5), (904, [math.inf] * 6),
       (905, [1.0, 2.0]), (906, [-0.0] * 6)]


def test_whitening_equals_exact_brute_force(spark):
    rows = vectors(1, 120, 6)
    check_whitening(spark, rows + ODD + [(500 + i, rows[0][1]) for i in range(60)] + [rows[3], rows[3]], 4)


def test_whitened_fit_list_has_identity_covariance(spark):
    rows = vectors(2, 300, 20)
    got = check_whitening(spark, rows)
    z = np.zeros((300, 16))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(z.T @ z / 300 - np.outer(z.mean(0), z.mean(0)) - np.eye(16)).max() < 1e-9


def test_whitening_of_wide_numbers_is_exact(spark):
    rows = vectors(3, 40, 3, [1e11, 3e6, 0.5])
    got = check_whitening(spark, rows, 3, exact=False)
    assert any(r.deviation is None for r in got)
    fit = np.array([integers(np.array(v, np.float32).astype(float)) for _, v in rows], object)
    exact = whitening.covariance(spark.createDataFrame([(3, p) for p in whitening.packed(fit.astype(np.int64))], "size int, x binary"),
                                 3, len(fit), fit.sum(0).tolist())[0]
    mean = [Fraction(int(s), len(fit)) for s in fit.sum(0)]
    assert exact == [[sum((int(x[i]) - mean[i]) * (int(x[j]) - mean[j]) for x in fit) / len(fit) for j in range(3)] for i in range(3)]


def test_whitening_without_variance_and_of_nothing(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [
        (i, k, 1, 0, None, None, 0.0) for i in (1, 2) for k in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in line if r.whitened is None} == {2} and line[0].identity_error < 1e-9
    for empty in ([], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(empty, "vec_id long, embedding array<float>")).count() == 0
