import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import common


def test_slices_hold_every_row_in_order():
    texts = ["a" * n for n in (0, 5, 700, 3, 2_000, 1, 0)] + [None]
    batch = pa.record_batch({"i": list(range(len(texts))), "t": pa.array(texts)})
    parts = list(common.slices([batch, batch.slice(0, 0)], 1, limit=600))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts and len(parts) > 2


def test_remainder_is_the_crc_of_the_id_as_text(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 123456789012)] + [(None,)], "i long")
    got = [r[0] for r in df.select(common.remainder(F.col("i"), 5)).collect()]
    assert got == [zlib.crc32(t) % 5 for t in (b"0", b"7", b"123456789012", b"")]


def test_without_drops_ids_and_keeps_columns(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(None, "n"), (3, "again")], "doc_id long, t string")
    left = common.without(df, spark.createDataFrame([(3,), (7,), (99,)], "x long"), "doc_id")
    assert left.columns == df.columns and sorted(repr(r["doc_id"]) for r in left.collect()) == sorted(map(repr, [*(i for i in range(50) if i not in (3, 7)), None]))
    assert common.without(df, spark.createDataFrame([(None,)], "x long"), "doc_id").count() == 51


def test_first_of_each_group(spark):
    rows = [(k, (i * 7919) % 1000) for k in (1, 2) for i in range(300)]
    got = common.first_of_each(spark.createDataFrame(rows, "k int, h int"), "k", ["h"], 9).collect()
    for k in (1, 2):
        assert sorted(r["h"] for r in got if r["k"] == k) == sorted(h for g, h in rows if g == k)[:9]


def stretches(*texts):
    ends = np.cumsum([len(t) for t in texts])
    return common.Stretches(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)


def thue_morse(k):
    a, b = b"a", b"b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_hashes_of_stretches_are_equal_only_for_equal_ones():
    texts = [b"abc", b"xabc"[1:], b"abcd", b"ab", b"", b"\0", b"\0\0", *thue_morse(3), *thue_morse(6), *thue_morse(10), *thue_morse(12)]
    names = stretches(*texts).names
    assert names[0] == names[1] and len(set(names.tolist())) == len(set(texts)) and (names != 0).all()


def test_a_store_tells_words_of_one_hash_apart(monkeypatch):
    real = common.Stretches._names
    monkeypatch.setattr(common.Stretches, "_names", lambda self: real(self) * np.uint64(0) + np.uint64(7))
    texts = [b"one", b"two", b"one", b"", b"x" * 64, b"x" * 65, b"x" * 500, b"x" * 65, b"abcdefgh", b"abcdefghi"]
    store = common.WordStore(100)
    number, new = store.numbers(stretches(*texts))
    assert [texts.index(t) for t in texts] == [texts.index(texts[list(number).index(k)]) for k in number]
    assert sorted(texts[i] for i in new) == sorted(set(texts)) and [number[i] for i in new] == list(range(len(new)))
    assert store.find(stretches(b"two", b"three", b"x" * 66)).tolist() == [number[1], -1, -1]


def test_store_grows():
    texts = [str(i).encode() * (1 + i % 30) for i in range(70_000)]
    store = common.WordStore(1 << 30)
    for a in (0, 100, 40_000):
        store.numbers(stretches(*texts[a:]))
    number = store.find(stretches(*texts))
    assert (number >= 0).all() and len(set(number.tolist())) == len(set(texts)) == len(store)


def test_helper_columns_have_names_of_their_own(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_Own int, _own_ int, x int")
    assert common.unused(df, "_own", "x", "y") == ["_own__", "x_", "y"]
    odd = spark.createDataFrame([(1, "a", "b", 2), (2, "a", "b", 2)], "doc_id long, _own_number string, _number string, _gone int")
    left = common.without(odd, spark.createDataFrame([(1,)], "x long"), "doc_id")
    assert [tuple(r) for r in left.collect()] == [(2, "a", "b", 2)] and left.columns == odd.columns
