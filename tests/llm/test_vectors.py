"""Whitening, SimHash tiles and centroid clustering against plain versions."""

import hashlib
import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from citegrain.llm import centroids, queries, simhash_tiles, whitening
from citegrain.llm.common import Scratch
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables absent")
VECTORS = "vec_id long, embedding array<double>, cluster string, x int, component int"


def odd_vectors(d, n=300, seed=1):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(6, d))
    rows = (centres[chance.integers(0, 6, n)] + 0.4 * chance.normal(size=(n, d))).round(3)
    rows[:, 0] *= 30
    found = [(k, v.tolist(), "c", 1, 2) for k, v in enumerate(rows)]
    found += [(k, rows[0].tolist(), "c", 1, 2) for k in range(n, n + n // 2)]
    found += [(7, rows[7].tolist(), "c", 1, 2), (7, rows[8].tolist(), "c", 1, 2), (None, rows[9].tolist(), None, None, None)]
    bad = [None, [], [1.0] * (d - 1), [None, *[1.0] * (d - 1)], [float("nan"), *[1.0] * (d - 1)], [float("inf")] * d]
    return found, found + [(9000 + k, v, "c", 1, 2) for k, v in enumerate(bad)]


# whitening

def plain_whitening(vectors, k=4, scale=256):
    """x by vector, n, sums, eigenvalues and axes of the distinct vectors."""
    x = np.array([[int(np.floor(scale * c)) for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, len(fit), fit.sum(0), values[::-1], axes[:, ::-1]


def check_whitening(rows, good, d):
    x, n, sums, values, axes = plain_whitening([v for _, v, *_ in good])
    k = min(4, d)
    assert len(rows) == k * len(good)
    expected = defaultdict(list)
    for (vec_id, *_), v in zip(good, x):
        expected[vec_id].append(v)
    told = defaultdict(list)
    for r in rows:
        told[r.vec_id, r.component].append(r)
    signs = {}
    for (vec_id, component), mine in told.items():
        theirs = [((v - sums / n) @ axes[:, component - 1] / np.sqrt(values[component - 1]),
                   sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))) for v in expected[vec_id]]
        if component not in signs and len(theirs) == 1 and abs(theirs[0][0]) > 0.1:
            signs[component] = np.sign(theirs[0][0] * mine[0].whitened)
        assert sorted(r.deviation for r in mine) == sorted(t[1] for t in theirs)
    for (vec_id, component), mine in told.items():
        theirs = sorted((v - sums / n) @ axes[:, component - 1] * signs[component] / np.sqrt(values[component - 1]) for v in expected[vec_id])
        assert np.allclose(sorted(r.whitened for r in mine), theirs, rtol=1e-9, atol=1e-9)
        for r in mine:
            assert r.n == n and r.identity_error < 1e-10
            assert abs(r.explained / (values[component - 1] / values.sum()) - 1) < 1e-10


@pytest.mark.parametrize("d", [8, 3])
def test_whitening_against_eigenvectors(spark, d):
    good, rows = odd_vectors(d)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    check_whitening(whitening.whiten(df).collect(), good, d)


@needs_tables
def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(queries.QUERIES["op11_whitening"](spark, SMALL).collect(), rows, 64)


def test_whitening_of_deficient_and_large_vectors(spark):
    chance = np.random.default_rng(4)
    flat = chance.normal(size=(80, 2)) @ chance.integers(-4, 5, size=(2, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(flat)], "vec_id long, embedding array<double>")
    exact = df.selectExpr("vec_id", "transform(embedding, c -> floor(c) * 1.0D) as embedding")
    for table in (df, exact):
        rows = whitening.whiten(table).collect()
        assert {r.identity_error < 1e-6 for r in rows} == {True} and len(rows) == 320
    line = spark.createDataFrame([(k, [k * 1.0, 2.0 * k, 5.0]) for k in range(50)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(line).collect()
    assert {r.component for r in rows} == {1, 2, 3}
    assert {r.whitened is None for r in rows if r.component > 1} == {True}
    assert {round(r.explained, 9) for r in rows} == {1.0, 0.0}
    alike = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(alike).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained) for r in rows} == {(1, 0, None, None)}
    huge = spark.createDataFrame([(1, [1e10, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r.deviation for r in whitening.whiten(huge).collect()}
    assert rows[1] is None
    empty = whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_factors_make_orthonormal_rows(spark):
    chance = np.random.default_rng(5)
    x = (chance.normal(size=(400, 6)) * [1e6, 1, 3, 1e4, 7, 50]).astype(np.int64)
    x[:, 5] = x[:, 0] + x[:, 4]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>")
    centring = whitening.Centring(400, [int(s) for s in x.sum(0)])
    factors = whitening.triangular_factors(df, centring, 6, 3)
    q = whitening.solved(centring(x), factors)
    full = factors[2] @ factors[1] @ factors[0]
    assert np.allclose(full, np.triu(full))
    centred = x - x.mean(0)
    assert np.abs(full.T @ full - centred.T @ centred).max() < 1e-9 * np.abs(centred.T @ centred).max()
    assert np.abs(q @ full - centred).max() < 1e-6


# SimHash

def plain_fingerprint(text):
    words = brute.WORD.findall((text or "").translate(brute.LOWER))
    runs = [words[k : k + 3] for k in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near_duplicates(rows, radius=3):
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct, union = sorted(set(prints)), brute.Union()
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= radius:
                union.join(a, b)
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            least[union.root(p)] = min(doc_id, least.get(union.root(p), doc_id))
    return sorted(((d, f"{p:016x}", least.get(union.root(p))) for (d, _), p in zip(rows, prints)), key=str)


def near_corpus(seed=1):
    chance = random.Random(seed)
    vocabulary = [f"wört{k}" for k in range(400)] + ["of", "the"]
    rows = []
    for _ in range(60):
        base = chance.choices(vocabulary, k=chance.randint(1, 200))
        rows.append(" ".join(base))
        for _ in range(chance.choice((0, 1, 6))):
            copy = [*base]
            for _ in range(chance.randint(0, 2)):
                copy[chance.randrange(len(copy))] = chance.choice(vocabulary)
            rows.append(chance.choice((" ", "\n", "\t\r")).join(copy).upper())
    long = chance.choices(vocabulary, k=70_000)
    rows += [" ".join(long), " ".join(long[:-1]), "", None, " \n\t", "a", "A b", "a B", "a b c", "a\x0bb\x0cc", "a\x00b c\x85d", "É é"]
    rows = list(enumerate(rows))
    return rows + [(None, rows[0][1]), (None, "only here without an id"), (3, rows[3][1]), (3, "another text of id three")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = near_corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'p' as print", "doc_id as root", "1 as cell")
    mine = simhash_tiles.near_duplicates(df.repartition(5))
    assert mine.columns == ["doc_id", "fingerprint", "component_id"]
    expected = plain_near_duplicates(rows)
    assert len({c for *_, c in expected}) < len({f for _, f, _ in expected})
    assert sorted((tuple(r) for r in mine.collect()), key=str) == expected


@pytest.mark.parametrize("tile", [1, 5, 1 << 14])
def test_links_join_all_within_the_radius(spark, tile):
    """Fingerprints around a few centres, at every distance, in one tile and in many."""
    chance, found = random.Random(tile), {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        at = chance.getrandbits(64)
        for _ in range(30):
            for b in chance.sample(range(64), chance.randint(1, 4)):
                at ^= 1 << b
            found.add(at)
    signed = [v - (1 << 64) if v >> 63 else v for v in found]
    classes = spark.createDataFrame([(v,) for v in signed], "print long").repartition(3)
    union, mine = brute.Union(), brute.Union()
    for a in found:
        for b in found:
            if (a ^ b).bit_count() <= 3:
                union.join(a, b)
    with Scratch(spark) as tables:
        edges = simhash_tiles.links(classes, 3, tables, tile).collect()
    mask = (1 << 64) - 1
    for a, b in edges:
        assert union.root(a & mask) == union.root(b & mask)
        mine.join(a & mask, b & mask)
    assert all((union.root(a) == union.root(b)) == (mine.root(a) == mine.root(b)) for a in found for b in found)
    assert len(edges) <= 65 * len(found)


def test_offsets_cover_the_ball_once():
    half = simhash_tiles.offsets(3)
    both = {*half, *(tuple(-v for v in f) for f in half)}
    assert len(both) == 2 * len(half) - 1 == 129 and all(sum(map(abs, f)) <= 3 for f in both)


@needs_tables
def test_near_duplicates_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    mine = sorted((tuple(r) for r in queries.QUERIES["op12_simhash"](spark, SMALL).collect()), key=str)
    assert mine == plain_near_duplicates(rows)


def test_near_duplicates_of_no_rows(spark):
    assert simhash_tiles.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# centroids

def plain_clusters(rows, clusters=8, rounds=10, scale=1024):
    x = [[int(np.floor(scale * c)) for c in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, hashlib.sha256(f"3:{rows[k][0]}".encode()).hexdigest(), x[k]))
    centres = [x[k] for k in order[:clusters]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    assign = lambda: [min((square(v, c), j) for j, c in enumerate(centres)) for v in x]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centres)):
            mine = [v for v, (_, k) in zip(x, of) if k == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    of = assign()
    sums = defaultdict(int)
    for distance, j in of:
        sums[j] += distance
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha[j]) for (i, _), (d, j) in zip(rows, of)), key=str)


@pytest.mark.parametrize("d, clusters", [(64, 8), (2, 5), (1, 1)])
def test_clusters_against_plain_rounds(spark, d, clusters):
    good, rows = odd_vectors(d, 200, seed=d)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    mine = centroids.cluster_vectors(df, dimensions=d, clusters=clusters)
    assert mine.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in mine.collect()), key=str) == plain_clusters([r[:2] for r in good], clusters)


def test_clusters_of_few_or_no_rows(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-0.5, 0.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in centroids.cluster_vectors(df, dimensions=2).collect()), key=str) == plain_clusters(few)
    empty = centroids.cluster_vectors(df, dimensions=64)
    assert empty.count() == 0 and "centroid_sha256" in empty.columns


@needs_tables
def test_clusters_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    mine = sorted((tuple(r) for r in queries.QUERIES["op13_centroids"](spark, SMALL).collect()), key=str)
    assert mine == plain_clusters(rows)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    sql = duck.sql(queries.ORACLES["op13_centroids"]).fetchall()
    assert sorted(sql, key=str) == mine


def test_loosening_bounds_every_point_of_the_sphere():
    chance, tighter = np.random.default_rng(6), 0
    for _ in range(300):
        d = int(chance.integers(1, 6))
        old, centre = chance.normal(size=(2, d)) * 10
        new = old + chance.normal(size=d) * chance.choice([0.01, 1, 10])
        radius = float(chance.choice([0, 0.5, 5, 20]))
        way = chance.normal(size=(4000, d))
        points = centre + radius * way / np.linalg.norm(way, axis=1, keepdims=True) * chance.random((4000, 1)) ** (1 / d)
        closer = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        bound = centroids.loosening(old, new, centre, radius)
        assert closer.max() <= bound
        tighter += bound < 0.9 * np.linalg.norm(new - old)
    assert tighter > 100


def test_bounds_spare_most_comparisons():
    chance = np.random.default_rng(7)
    x = (1000 * chance.normal(size=(8, 16)))[chance.integers(0, 8, 4000)] + 150 * chance.normal(size=(4000, 16))
    x = x.astype(np.int64)
    now, before, scanned = x[:8].copy(), None, []
    cluster = upper = lower = None
    for k in range(8):
        if before is None:
            cluster, upper, lower = centroids.nearest(x, now)
        else:
            radii = np.array([upper[cluster == j].max(initial=0) for j in range(8)]) * (1 + centroids.MARGIN)
            cluster, upper, lower, unsure = centroids.reassigned(x, cluster, upper, lower, centroids.Moves(now, before, radii))
            scanned.append(len(unsure))
        assert (cluster == centroids.squared(x, now).argmin(1)).all()
        before = now
        now = np.array([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else now[j] for j in range(8)])
    assert sum(scanned) < 0.5 * len(scanned) * len(x)
