"""Hard negatives, whitening and URL verdicts against brute force, on real and awkward tables."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talus.llm import lemp, spectrum, url_filter, whitening

from tests.llm.conftest import SMALL

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, row string, x string, length int, n int, score int"


def table(spark, rows):
    """Rows (vec_id, embedding, label) with further columns named like the operators' own."""
    return spark.createDataFrame([(*r, "r", "x", 1, 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet")


@pytest.fixture(scope="module")
def clustered(spark):
    """Rows of very different lengths around a few directions, a third of them one and the same vector."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(1500):
        v = np.ones(16) if i % 3 == 0 else centres[i % 12] + 0.2 * rng.standard_normal(16)
        rows.append((i, (v * 2.0 ** (i % 5 - 2)).tolist(), i * 7 % 5))
    return table(spark, rows)


def brute_force(rows):
    """(anchor, positive, rank, negative, positive score, negative score) by plain loops, rows as (id, vector, label)."""
    kept = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in v], label))
    order = lambda hit: (-hit[0], hit[1] is None, hit[1] or 0)
    out = []
    for i, (anchor, x, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), j_id, l) for j, (j_id, y, l) in enumerate(kept) if j != i]
        positives = sorted([s for s in scored if s[2] == label], key=order)[:5]
        others = sorted([s for s in scored if s[2] != label], key=order)
        for p, p_id, _ in positives:
            hits = [s for s in others if 80 * p <= 100 * s[0] <= 100 * p][:5]
            out += [(anchor, p_id, r, n_id, p, n) for r, (n, n_id, _) in enumerate(hits, 1)]
    return sorted(out, key=str)


def mined(df):
    return sorted((tuple(r) for r in lemp.mine(df).collect()), key=str)


def plain(df):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in df.select("vec_id", "embedding", "label").collect()]


# Hard negatives


def test_mined_rows_equal_brute_force(embeddings):
    assert mined(embeddings) == brute_force(plain(embeddings))


@pytest.mark.parametrize("group", [lemp.GROUP, 6])
def test_hot_vectors_and_lengths(clustered, monkeypatch, group):
    monkeypatch.setattr(lemp, "GROUP", group)
    monkeypatch.setattr(lemp, "PART_ROWS", 400)
    monkeypatch.setattr(lemp, "BUCKET", 128)
    assert mined(clustered) == brute_force(plain(clustered))


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.5], 3),
        (0, [1.0, 0.5], 3),
        (100, [0.5, 0.25, 4.0], 1),
        (200, [-1.0, 0.0], 4),
        (300, [], 4),
        (400, [0.0, 0.0], 5),
        (1, [0.9, 0.5], 3),
        (2, [0.9, 0.4], 1),
        (3, [0.9, 0.4], 1),
        (None, [0.9, 0.4], 4),
        (None, [0.95, 0.5], 3),
        (4, None, 1),
        (5, [1.0, None], 1),
        (6, [NAN, 1.0], 1),
        (8, [INF, 1.0], 1),
        (9, [1.0, 1.0], None),
        (7, [1.0, 0.5], 0),
        (10, [0.001, 30_000.0], 2),
    ]
    df = table(spark, rows)
    assert mined(df) == brute_force(rows)
    assert mined(df.limit(0)) == []
    assert mined(df.where("vec_id IS NULL")) == []


def test_very_long_vectors_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 50, (rng.standard_normal(300) * 20_000).tolist(), i % 3) for i in range(12)]
    assert mined(table(spark, rows)) == brute_force(rows)


def test_ranges_hold_every_row_with_the_cosine():
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((400, 6)) * 100)
    length = np.sqrt((x * x).sum(axis=1))
    batch = pa.RecordBatch.from_pydict({"row": np.arange(400), "vec_id": np.arange(400), "label": np.zeros(400, int), "x": x.astype(int).tolist(), "length": length})
    bucket = lemp.Bucket(batch, 6)
    q = lemp.Requests(np.arange(400), np.zeros(400, int), x, np.arange(400), np.zeros(400, int), np.zeros(400, int), True, 5)
    pruned = 0
    for a in range(400):
        for cosine in (0.5, 0.9, 0.99):
            found = bucket.candidates(q.unit[a], q.focus[a], cosine)
            want = set(np.flatnonzero(bucket.unit @ q.unit[a] >= cosine).tolist())
            if found is not None:
                pruned += 1
                assert want <= set(found.tolist())
                assert len(found) < 200
    assert pruned > 500


# Spectrum slicing and whitening


def spread(rng, values):
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = turn @ np.diag(values) @ turn.T
    return (a + a.T) / 2


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for _ in range(60):
        values = rng.standard_normal(9).round(1)
        a = spread(rng, values)
        for shift in (-2.05, -0.55, 0.05, 0.75):
            assert spectrum.count_above(a, shift) == (values > shift).sum()
    assert spectrum.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert spectrum.count_above(np.diag([2.0, 0.0, -1.0]), 0.0) == 1


@pytest.mark.parametrize("values", [[5.0, 4, 3, 2, 1], [1.0, 1, 1, 0, 0], [9.0, 9 - 1e-7, 9 - 2e-7, 1, 0], [0.0] * 4, [1e-9, 1e9, 3, 3 + 1e-3], [7.0]])
def test_leading_eigenpairs(values):
    a = spread(np.random.default_rng(2), values)
    found, vectors = spectrum.leading(a, 3)
    want = np.sort(values)[::-1][:3]
    scale = max(np.abs(values).max(), 1e-300)
    assert np.abs(found - want).max() <= 1e-13 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-9
    assert np.abs(vectors @ a - found[:, None] * vectors).max() <= 1e-12 * scale


def reference_whitening(rows, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in rows], dtype=float)
    d = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(d.T @ d / len(x))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return x, d @ vectors / np.sqrt(values), values


def test_whitening_against_a_plain_version(embeddings):
    rows = whitening.whiten(embeddings).collect()
    source = sorted(plain(embeddings))
    x, want, values = reference_whitening([r[1] for r in source], 32)
    n, sums = len(source), x.sum(axis=0).astype(np.int64)
    place = {r[0]: i for i, r in enumerate(source)}
    got = np.zeros_like(want)
    for r in rows:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert len(rows) == n * 32 and {r["n"] for r in rows} == {n}
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-8
    deviation = {r["vec_id"]: r["deviation"] for r in rows}
    assert all(deviation[s[0]] == sum((n * int(v) - int(t)) ** 2 for v, t in zip(x[i], sums)) for i, s in enumerate(source))
    total = np.var(x, axis=0).sum()
    shares = {r["component"]: r["explained"] for r in rows}
    assert np.abs(np.array([shares[c] for c in range(1, 33)]) / (values / total) - 1).max() < 1e-9
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_whitening_of_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [2.0, -1.0], None), (2, [3.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [NAN, 1.0], 1), (6, [-INF, 1.0], 1)]
    found = whitening.whiten(table(spark, rows)).collect()
    assert sorted(str(r["vec_id"]) for r in found if r["component"] == 1) == ["1", "1", "2", "None"]
    _, want, _ = reference_whitening([[1.0, 2.0], [1.0, 2.0], [2.0, -1.0], [3.0, 0.0]], 2)
    first = sorted(abs(r["whitened"]) for r in found if r["component"] == 1)
    assert np.abs(np.array(first) - np.sort(np.abs(want[:, 0]))).max() < 1e-9
    assert whitening.whiten(table(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, [], 0)])).count() == 0


def test_whitening_without_variance(spark):
    same = whitening.whiten(table(spark, [(i, [0.5, 0.25], 0) for i in range(4)])).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, None, None, 0)}
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i], 0) for i in range(4)])).collect()
    assert {r["whitened"] for r in line if r["component"] == 2} == {None}
    assert all(r["identity_error"] < 1e-9 for r in line)
    huge = whitening.whiten(table(spark, [(0, [3e38, 0.0], 0), (1, [-3e38, 1.0], 0), (2, [0.0, 2.0], 0)])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] == 0} == {None}
    assert all(r["whitened"] is not None for r in huge if r["component"] == 1)


# URL verdicts


def plain_address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def plain_score(host, path, weights):
    """One row at a time: distinct n-grams found by slicing, hashed one by one."""
    slots = set()
    for part, value in enumerate((b"^" + host.encode() + b"$", path.encode())):
        for size in url_filter.SIZES:
            for i in range(len(value) - size + 1):
                data = np.frombuffer(value[i : i + size], np.uint8)
                h = url_filter.span_hashes(data, np.array([0]), np.array([size]))[0]
                slots.add(int((int(h) + part) % (1 << 64) % url_filter.ROWS))
    total = sum(weights[s] for s in slots) / math.sqrt(max(len(slots), 1))
    return 1 / (1 + math.exp(-(weights[-1] + total)))


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://ORG", "http://org/", "x://A.Org/p?q#f", "http://notorg/", "https://EXAMPLE.org/es/1", "https://m.example.org/en/12?x",
    "https://m.example.org/en/2", "http://a.com/fr/", "http://a.com/de/x#y", "http://a.com?u=http://b.org/", "http://b.net#x/y", "http://ÄÖ.net/ä", "a://b://c/d", "http://x.net/a\nb",
    "http://casino-win.net/", "http://www.quiet-garden.net/en/1", "http://x.com/" + "long/" * 5000,
]


def judged(df, **how):
    return [tuple(r) for r in url_filter.judge(df, **how).collect()]


@pytest.mark.parametrize("rules", [url_filter.RULES, (("b.net", "", "allow"), ("net", "/a", "block"), ("x.net", "/", "allow"), ("x.net", "/", "block")), ()])
def test_urls_against_a_plain_version(spark, rules):
    weights = url_filter.train(url_filter.training_urls())
    df = spark.createDataFrame([(i, u, "h", "p", "r", "v", "s") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string, verdict string, score string")
    for page_id, host, path, rule, verdict, score in judged(df, rules=rules):
        assert (host, path) == plain_address(URLS[page_id])
        named, says = plain_rule(host, path, rules)
        want = plain_score(host, path, weights)
        assert rule == named and score == pytest.approx(want, abs=1e-9)
        assert verdict == (says or ("block" if want >= url_filter.CUTOFF else "allow"))


def test_urls_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = url_filter.train(url_filter.training_urls())
    rows = judged(pages)
    urls = {r["page_id"]: r["url"] for r in pages.select("page_id", "url").collect()}
    assert len(rows) == pages.count()
    for page_id, host, path, rule, verdict, score in rows:
        assert (host, path) == plain_address(urls[page_id])
        named, says = plain_rule(host, path, url_filter.RULES)
        assert rule == named and verdict == (says or ("block" if plain_score(host, path, weights) >= 0.5 else "allow"))


def test_held_out_urls():
    weights = url_filter.train(url_filter.training_urls())
    host, path, label = zip(*url_filter.training_urls(seed=99))
    slots, first = url_filter.features(pa.array(host), pa.array(path))
    blocked = url_filter.margins(slots, first, weights) >= 0
    label = np.array(label, bool)
    assert blocked[label].mean() > 0.85 and blocked[~label].mean() < 0.01
    assert not url_filter.train([]).any()


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "http://a.net/"), (1, None), (1, None)], "page_id int, url string")
    assert len(judged(df)) == 3
    assert judged(df.where(F.lit(False))) == []
