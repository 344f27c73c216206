import hashlib
import random
import re
import time

from gridloom.llm import exact_dedup as own
from gridloom.llm.exact_dedup import drop_copies, exact_dedup

CASES = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "a\xa0b"), (8, "x" * 300_000), (9, "x" * 300_000 + " "), (10, "é"), (None, "ab"), (12, "z"), (12, "z")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        same = [(-len(rows[k][1] or ""), 1 << 63 if rows[k][0] is None else rows[k][0], rows[k][0]) for k, m in enumerate(norm) if m == n]
        out.append((i, min(same)[2], len(same), hashlib.sha256(n.encode()).hexdigest()))
    return out


def same(spark, rows, **kw):
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **kw).collect()
    order = lambda x: sorted(x, key=repr)
    assert order((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == order(brute(rows))
    groups = {}
    for r in got:
        groups.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(k) == 1 for k in groups.values())


def test_cases(spark):
    same(spark, CASES)


def test_random_groups_and_a_hot_one(spark):
    rng = random.Random(1)
    same(spark, [(i, rng.choice(["hot copy", f"t {rng.randrange(40)}", f"t{rng.randrange(40)} "])) for i in range(600)], radix=2)


def test_empty_table_and_clashing_columns(spark, docs_of):
    assert exact_dedup(docs_of([])).count() == 0
    docs = docs_of(CASES)
    assert exact_dedup(docs).count() == len(CASES)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 6, 7, 9, 10, 12]
    assert drop_copies(docs_of([])).count() == 0


def test_many_equal_rows_merge_in_linear_time():
    n = 300_000
    one = [[0] * n, [b"s" * 32] * n, [3] * n, [b"c" * 8] * n, [5] * n, range(n, 0, -1), [i % 50 for i in range(n)], range(n), [1] * n, [[i % 50] for i in range(n)]]
    batch = own.record(own._ENTRY_ARROW, *one)
    began = time.process_time()
    (got,) = own._merged(iter([batch.slice(a, 1000) for a in range(0, n, 1000)]))
    assert time.process_time() - began < 30
    assert got.to_pylist()[0] | {"runs": 0} == {"slot": 0, "sha": b"s" * 32, "size": 3, "check": b"c" * 8, "chars": 5, "doc_id": 1, "run": (n - 1) % 50, "pos": n - 1, "rows": n, "runs": 0}
    assert got.to_pylist()[0]["runs"] == list(range(50))


def test_columns_of_any_name_come_back(docs_of):
    docs = docs_of([(1, "a b"), (2, "ab"), (3, "c"), (3, "c")])
    left = drop_copies(docs).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["__own"], r["_place"]) for r in left] == [(1, "a", "f"), (3, "a", "f")]
