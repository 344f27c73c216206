import random

import numpy as np
import pytest

from gridloom.llm import near_dedup as nd


def brute(rows, width, percent=80):
    sets = [nd.shingle_set((t or "").encode(), width) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for a in range(len(rows)):
        if rows[a][0] is None:
            continue
        first.setdefault(rows[a][0], a)
        if first[rows[a][0]] != a:
            up[find(a)] = find(first[rows[a][0]])
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[b][0] is not None and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted((repr(i), len(s), repr(None if i is None else least[find(a)])) for a, ((i, _), s) in enumerate(zip(rows, sets)))


def same(docs_of, rows, width):
    got = nd.near_duplicates(docs_of(rows).repartition(3), width).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == brute(rows, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def copies(rng, groups, vocabulary=400):
    out = []
    for size, length, changes in groups:
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(changes):
                own[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("width, seed", [(2, 1), (5, 2)])
def test_against_all_pairs(docs_of, width, seed):
    # changes that put pairs on both sides of the threshold
    rng = random.Random(seed)
    same(docs_of, copies(rng, [(12, 120, 3), (6, 80, 6), (4, 40, 1), (30, 60, 0), (15, 100, 4)]), width)


def test_a_large_group_that_no_leader_joins(docs_of, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 3)
    rng = random.Random(3)
    same(docs_of, copies(rng, [(70, 90, 4), (25, 90, 5)]), 2)


def test_hot_bands_are_split(docs_of, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 10)
    rng = random.Random(4)
    same(docs_of, copies(rng, [(50, 80, 2), (20, 60, 1)]), 2)


def test_pairs_that_a_salt_parts_are_found(docs_of, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 0.1)
    same(docs_of, copies(random.Random(8), [(2, 80, 2)] * 12 + [(3, 60, 1)] * 4), 2)


def test_all_members_of_salted_bands_are_set_aside():
    keys = np.arange(nd.TABLES, dtype=np.uint32)[None, :].repeat(3, 0)
    args = np.array([1, 2, 3]), np.array([10, 10, 10]), keys, 80, np.array([7, 7, 7], np.uint64)
    pairs, aside = nd._bucket_pairs(np.array([0, 1, 1]), np.array([True] * 3), *args)
    assert {(a, b) for x, y in pairs for a, b in zip(x.tolist(), y.tolist())} == {(2, 3)}
    assert [sorted(ids.tolist()) for _, ids in aside if len(ids)] == [[1, 2, 3]] * nd.TABLES
    assert all(len(set(name.tolist())) == 1 for name, ids in aside if len(ids))
    assert not any(len(ids) for _, ids in nd._bucket_pairs(np.array([0, 1, 1]), np.array([False] * 3), *args)[1])


def test_edge_cases(docs_of):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one one"), (7, "a b c d"), (8, "A  b\tc d"), (9, long), (10, long + " end"), (11, "é ü"), (12, "É ü"), (None, "one"), (14, "a b c d"), (14, "a b c d")]
    same(docs_of, rows, 2)
    same(docs_of, rows, 5)
    left = nd.drop_near_copies(docs_of(rows), 2)
    assert left.columns == docs_of(rows).columns
    assert sorted(repr(r["doc_id"]) for r in left.collect()) == sorted(map(repr, [1, 2, 3, 4, 6, 7, 9, 11, 12, None]))
    assert nd.near_duplicates(docs_of([])).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in nd.components(spark.createDataFrame(edges, "one long, two long").repartition(6)).collect()}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == find(x) for x in up)


def test_minhashes_estimate_the_similarity():
    a = [f"a{i} b{i}" for i in range(800)]
    texts = [" ".join(a).encode(), " ".join(a[:600] + [f"c{i} d{i}" for i in range(200)]).encode()]
    x, y = nd.minhashes(nd.shingle_hashes(texts, 2))
    true = len(nd.shingle_set(texts[0], 2) & nd.shingle_set(texts[1], 2)) / len(nd.shingle_set(texts[0], 2) | nd.shingle_set(texts[1], 2))
    assert abs((x == y).mean() - true) < 0.15


def test_shingle_hashes_count_distinct_shingles():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["A", "a", "b", "é"]) for _ in range(n)).encode() for n in (0, 1, 2, 3, 40)]
    for width in (1, 2, 5):
        assert [len(x) for x in nd.shingle_hashes(texts, width)] == [len(nd.shingle_set(t, width)) for t in texts]


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_first_shingles_meet_with_room(percent):
    """Every pair that is similar enough shares a shingle of the smaller set's index and the larger one's probe."""
    rng = np.random.default_rng(7)
    often = rng.integers(0, 50, nd.BINS)
    for _ in range(1500):
        n = int(rng.integers(1, 40))
        base = nd.mix64(rng.integers(0, 1 << 60, n + 12).astype(np.uint64))
        a, b = np.unique(base[:n]), np.unique(np.concatenate([base[: n - rng.integers(0, n // 4 + 1)], base[n : n + rng.integers(0, n // 4 + 1)]]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or not len(b):
            continue
        (x, index), (y, _) = (nd.first_shingles(s, often, percent) for s in sorted((a, b), key=len))
        n, m = sorted((len(a), len(b)))
        met = [(i, int(np.flatnonzero(y == h)[0])) for i, h in enumerate(x[:index]) if h in y]
        assert any((100 + percent) * min(n - i, m - j) >= percent * (n + m) for i, j in met)


def test_common_text_is_no_reason_to_meet(docs_of, monkeypatch):
    """Documents that share a template but are not similar enough make few pairs, however many they are."""
    monkeypatch.setattr(nd, "SMALL", 3)
    rng = random.Random(9)
    template = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(template + [f"own{i}x{k}" for k in range(22)])) for i in range(1, 81)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(5)]
    seen = []
    real = nd._Run.links
    monkeypatch.setattr(nd._Run, "links", lambda self, pairs: seen.append(pairs.count()) or real(self, pairs))
    rng.shuffle(rows)
    same(docs_of, rows, 2)
    assert len(seen) < 2 or seen[1] < 100


def test_words_that_a_sum_of_powers_confuses(docs_of):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, f"x {a} y"), (2, f"x {b} y"), (3, f"x {a} x {b}")]
    same(docs_of, rows, 2)
    assert [r["n_shingles"] for r in nd.near_duplicates(docs_of(rows), 2).orderBy("doc_id").collect()] == [2, 2, 3]


def test_same_shingles_in_another_order_are_linked(docs_of):
    words = [f"w{i}" for i in range(30)]
    turned = words[10:] + words[:11]
    same(docs_of, [(1, " ".join(words + words[:1])), (2, " ".join(turned)), (3, " ".join(words + words[:1]).upper())], 2)


def test_a_member_is_set_aside_once_a_band():
    n = 4 * nd.SMALL
    band, salt, ids, sizes = np.full(n, 7, np.int64), np.full(n, -1, np.int32), np.arange(n, dtype=np.int64), np.full(n, 50, np.int64)
    keys = np.arange(nd.TABLES, dtype=np.uint32).tobytes()
    batch = nd.pa.RecordBatch.from_arrays([*map(nd.pa.array, (band, salt, ids, sizes)), nd.pa.array([keys] * n)], names=["band", "salt", "id", "n", "b"])
    found = [r for b in nd._collide(80)(iter([batch])) for r in b.to_pylist() if r["bucket"] is not None]
    assert sorted((r["bucket"], r["one"]) for r in found) == [(7, i) for i in range(n)]
