import math

import numpy as np
import pytest

from gridloom.llm import projected_ann as ann

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in rows], VECTORS)


def exact(rows, k, every=100):
    use = [(i, v) for i, v in rows if i is not None and v and any(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in use:
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.float32(b).astype(float) - np.float32(a).astype(float)) ** 2).sum())), i) for i, b in use if i != q and len(b) == len(a))
            out[q] = near[:k]
    return out


@pytest.mark.parametrize("seed, n, width", [(1, 1500, 16), (2, 900, 64)])
def test_recall_and_scores(spark, seed, n, width):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    rows = [(i, (centres[i % 8] + 0.5 * rng.normal(size=width)).tolist()) for i in range(n)]
    got = ann.nearest(table(spark, rows), part_rows=200, query_block=5).collect()
    want = exact(rows, 10)
    assert {r["query_id"] for r in got} == set(want)
    hits = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & {i for _, i in w}) for q, w in want.items())
    assert hits / (10 * len(want)) >= 0.95
    vector = dict(rows)
    for r in got:
        d = np.float32(vector[r["query_id"]]).astype(float) - np.float32(vector[r["vec_id"]]).astype(float)
        assert r["score"] == pytest.approx(float(np.sqrt((d * d).sum())), rel=1e-12)


def test_unusable_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 1.0, 1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (None, [1.0, 0.5])]
    got = ann.nearest(table(spark, rows), k=10).collect()
    by = {q: [(r["vec_id"], round(r["score"], 9)) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100)}
    assert by == {0: [(100, 0.0), (1, 1.0), (2, 1.0)], 100: [(0, 0.0), (1, 1.0), (2, 1.0)]}


def test_empty_and_alone(spark):
    assert ann.nearest(table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(0, [1.0])])).count() == 0


def test_very_large_and_very_small_vectors_and_ids(spark):
    big, tiny, far = 1e200, 1e-200, (1 << 53) + 1
    rows = [(0, [big, big]), (1, [big, 2 * big]), (2, [4 * big, big]), (far, [tiny, 0.0]), (far - 1, [0.0, 3 * tiny]), (100 * (1 << 50), [tiny, 5 * tiny])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, k=2).collect()}
    assert got[0, 1] == (1, pytest.approx(big)) and got[0, 2][1] == pytest.approx(math.sqrt(2) * big)
    assert got[100 * (1 << 50), 1] == (far - 1, pytest.approx(math.sqrt(5) * tiny)) and got[100 * (1 << 50), 2] == (far, pytest.approx(5 * tiny))


def test_a_vector_of_very_many_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(i, [1.0, 2.0 + i / 1000]) for i in range(400, 450)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, k=5, part_rows=20).collect()
    for q in (0, 100, 200, 300):
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for i in range(7) if i != q][:5]


def test_large_partitions_are_searched_in_chunks(spark, monkeypatch):
    """A sample too small to split the vectors: one partition in many chunks gives the same neighbours."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 20)
    rng = np.random.default_rng(11)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(700, 8)).tolist())]
    got = ann.nearest(table(spark, rows), k=6, part_rows=40, query_block=3, certainty=0.9999).collect()
    for q, want in exact(rows, 6).items():
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [i for _, i in own] == [i for _, i in want] and [n for n, _ in own] == list(range(1, 7))


def test_the_share_of_vectors_read_falls_with_the_table(spark):
    """Vectors on a surface of few dimensions: a query reads little more of a table eight times as large."""
    rng, read = np.random.default_rng(6), []
    spread = rng.normal(size=(3, 32))
    for n in (1500, 12_000):
        points = rng.normal(size=(n, 3)) @ spread + 0.01 * rng.normal(size=(n, 32))
        df = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "vec_id long, embedding array<double>")
        found = ann.searches(df, 10, 100, "vec_id", "embedding", 8, 0.98, 300, 4096)
        each = found.groupBy("query_id").agg({"read": "sum"}).toPandas()["sum(read)"]
        assert len(each) == n // 100
        read.append(each.mean() / n)
    assert read[1] < read[0] / 2


def test_top_of_the_tree():
    points = np.random.default_rng(3).normal(size=(5000, 4))
    points[:2000] = points[0]
    top = ann.top_of_tree(points[:4000], 16)
    place = top.place(points)
    assert top.parts == 16 and set(place) == set(range(16)) and len(set(place[:2000])) == 1
    assert np.bincount(place[2000:]).max() < 700
    assert ann.top_of_tree(np.ones((50, 4)), 8).parts == 1


@pytest.mark.parametrize("p, dims, x", [(0.95, 2, 5.991), (0.95, 8, 15.507), (0.99, 6, 16.812)])
def test_chi_square_quantile(p, dims, x):
    assert ann.chi_square_quantile(p, dims) == pytest.approx(x, abs=1e-3)


def test_leaves_hold_every_row_once_within_their_boxes():
    points = np.random.default_rng(3).normal(size=(1000, 4))
    points[:300] = points[0]
    order, bounds, low, high = ann.kd_leaves(points, 32)
    assert sorted(order) == list(range(1000)) and bounds[0, 0] == 0 and bounds[-1, 1] == 1000
    for (a, b), lo, hi in zip(bounds, low, high):
        assert (points[order[a:b]] >= lo).all() and (points[order[a:b]] <= hi).all() and b - a <= 32
