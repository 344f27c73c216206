import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import repair_files, tier_packing
from gridloom.llm.tokens import BYTE_BPE, Encoder

POOL = [chr(i) for i in range(0x250)] + [" "] * 60 + ["'"] * 20 + list("abcdest") * 20 + ["\n"] * 10 + list("0123") * 4 + ["\x85", "\xa0", "\x1c", "\u2003", "é", "€", "日"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["".join(rng.choice(POOL) for _ in range(rng.randrange(60))) for _ in range(800)] + ["x" * 500 + " y" * 3, " " * 100 + "a", "", "\n\n b\n", "it's <|endoftext|> we'll"]


def test_same_ids_as_the_library(library, texts):
    own = Encoder(BYTE_BPE, kept=200)
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        assert own.encode([t.encode() for t in part]) == [library(t).astype("<u4").tobytes() for t in part]


ROWS = [(1, None), (2, ""), (3, "one two three"), (5, "long words " * 30_000), (5, "long words " * 30_000), (None, "no id"), (7, "日本 it's")] + [(100 + i, f"text number {i} " * (i % 90 + 1)) for i in range(150)]


def ids_of(library, text, end):
    return np.append(library(text or ""), end).astype("<u4")


def test_packing_places_every_id_once(docs_of, library):
    got = tier_packing.pack_documents(docs_of(ROWS).repartition(3)).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
        assert r["doc_tokens"] >= r["start"] + r["length"] and r["length"] > 0
    for doc_id in {i for i, _ in ROWS}:
        copies = [t for i, t in ROWS if i == doc_id]
        ids = ids_of(library, copies[0], 0)
        reach = np.zeros(len(ids), int)
        for start, length, crc in pieces[doc_id]:
            reach[start : start + length] += 1
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
        assert (reach == len(copies)).all()


def test_sequences_are_full_but_for_one_a_partition(docs_of):
    got = tier_packing.pack_documents(docs_of(ROWS).coalesce(1)).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"], r["step_group"]))
    short = 0
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist()
        n = sum(p[1] for p in parts)
        assert len({p[2:] for p in parts}) == 1 and n <= parts[0][2] <= 1024
        short += n < parts[0][2]
    assert short <= 1
    load = defaultdict(int)
    for parts in sequences.values():
        load[parts[0][3]] += parts[0][2]
    assert max(load.values()) <= tier_packing.STEP_TOKENS


@pytest.mark.parametrize("pool", [1, 2, 7, 1000])
def test_packer_with_any_pool(pool):
    rng = random.Random(pool)
    packer = tier_packing.Packer(0, window=64, smallest=8, step_tokens=256, pool=pool)
    total = 0
    for i in range(200):
        n = rng.randrange(1, 200)
        total += n
        packer.add(i, b"\1\0\0\0" * n)
    packer.pack(last=True)
    assert sum(r[2] for r in packer.take()) == total


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 6, rng.integers(0, 400)).astype(np.uint16) for _ in range(12)] + [np.zeros(50, np.uint16)]
    ends = np.cumsum([len(d) for d in docs])
    grammar, symbols, places = repair_files.compress(np.concatenate(docs), ends, 6, rounds=5, frequent=200)
    assert np.array_equal(grammar.expand(symbols), np.concatenate(docs)) and len(grammar.rules)
    row = repair_files._shard_row(0, 0, 0, list(enumerate(docs)), 6)
    names = [f.name for f in repair_files._SHARD_ARROW]
    shard = repair_files.Shard(dict(zip(names, row)))
    for k, d in enumerate(docs):
        assert np.array_equal(shard.decode(k), d)
        for i in rng.integers(0, max(1, len(d)), 5):
            if i < len(d):
                assert shard.id_at(k, int(i)) == d[i]
    with pytest.raises(IndexError):
        shard.id_at(0, len(docs[0]))


def test_rules_expand_to_their_lengths():
    ids = np.tile(np.array([1, 2, 3], np.uint16), 400)
    grammar, symbols, _ = repair_files.compress(ids, np.array([len(ids)]), 10)
    for i, n in enumerate(grammar.lengths):
        assert len(grammar.expand(np.array([10 + i], np.uint32))) == n
    assert len(symbols) < len(ids) / 3


def most_repeated(symbols, ends):
    """Occurrences without overlap of the pair that has most, within documents."""
    counts = defaultdict(int)
    for a, b in zip([0, *ends[:-1]], ends):
        before = None
        for pair in zip(symbols[a:b].tolist(), symbols[a + 1 : b].tolist()):
            before = None if pair == before else pair
            counts[before] += before is not None
    return max(counts.values())


@pytest.mark.parametrize("size", [3_000, 150_000])
def test_no_pair_is_left_twice_whatever_the_size(size):
    rng = np.random.default_rng(size)
    ids = (rng.zipf(1.2, size) % 5_000).astype(np.uint16)
    phrase = np.arange(6_000, 6_030, dtype=np.uint16)
    for at in range(100, size - 100, size // 5):
        ids[at : at + 30] = phrase
    ends = np.append(np.arange(90, size, size // 20), size)
    grammar, symbols, places = repair_files.compress(ids, ends, 7_000)
    assert most_repeated(symbols, places.tolist()) == 1
    assert 30 <= grammar.lengths.max() and np.array_equal(grammar.expand(symbols), ids)
    for a, b, c, d in zip([0, *ends[:-1]], ends, [0, *places[:-1]], places):
        assert np.array_equal(grammar.expand(symbols[c:d]), ids[a:b])


def test_rounds_stay_few_on_ascending_and_on_equal_ids():
    for ids in (np.tile(np.arange(4_000, dtype=np.uint16), 2), np.zeros(8_000, np.uint16)):
        grammar, symbols, _ = repair_files.compress(ids, np.array([len(ids)]), 5_000)
        assert len(grammar.levels) < 40 and most_repeated(np.append(symbols, 0), [len(symbols) + 1]) == 1 and np.array_equal(grammar.expand(symbols), ids)


def test_pairs_too_wide_for_one_value_give_the_same_sequence():
    ids = np.random.default_rng(1).integers(0, 9, 2_000).astype(np.uint16)
    narrow, wide = (repair_files.compress(ids, np.array([len(ids)]), top) for top in (9, 1 << 30))
    new = narrow[1] >= 9
    assert np.array_equal(np.where(new, narrow[1].astype(np.int64) - 9 + (1 << 30), narrow[1]), wide[1]) and np.array_equal(wide[0].expand(wide[1]), ids)


@pytest.mark.parametrize("first_new", [6, 250, 65_500, 1 << 24])
def test_shards_of_any_width(first_new):
    docs = [np.random.default_rng(i).integers(0, 6, 400).astype(np.uint16) for i in range(9)]
    row = dict(zip([f.name for f in repair_files._SHARD_ARROW], repair_files._shard_row(0, 0, 0, list(enumerate(docs)), first_new)))
    shard = repair_files.Shard(row)
    assert (1 << 8 * (row["width"] - 1)) <= first_new + len(shard.grammar.rules) - 1 < 1 << 8 * row["width"]
    assert all(np.array_equal(shard.decode(k), d) and shard.id_at(k, 7) == d[7] for k, d in enumerate(docs))


def test_files_in_order_of_ids(docs_of, library):
    rows = [r for r in ROWS if r[0] != 5] + [(5, "five")]
    got = repair_files.encode_to_files(docs_of(rows).repartition(4), shard_ids=300).collect()
    start = 0
    for (i, t), r in zip(sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), sorted(got, key=lambda r: r["start"])):
        ids = ids_of(library, t, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert repair_files.encode_to_files(docs_of(ROWS)).count() == len(ROWS)


def test_empty_tables(docs_of):
    assert tier_packing.pack_documents(docs_of([])).count() == 0
    assert repair_files.encode_to_files(docs_of([])).count() == 0


def test_files_stay_in_a_folder(docs_of, spark, tmp_path):
    rows = [(i, f"text {i} " * 20) for i in range(30)]
    out = str(tmp_path / "files")
    got = repair_files.encode_to_files(docs_of(rows), out=out).orderBy("doc_id").collect()
    again = repair_files.read_documents(repair_files.open_files(spark, out)).orderBy("doc_id").collect()
    assert got == again and len(again) == 30


def test_rows_of_one_id_are_dealt_to_several_files(docs_of):
    rows = [(7, f"copy {i}") for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(i, "x") for i in range(100, 150)]
    shards = repair_files.write_files(docs_of(rows).repartition(4))
    held = [len(r["doc_ids"]) for r in shards.select("doc_ids").collect()]
    assert len(held) > 2 and max(held) < 400
    got = repair_files.read_documents(shards).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == [None] * 300 + [7] * 300 + list(range(100, 150))
    assert [r["start"] for r in got] == list(np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]))
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(np.array([*Tokenizer.from_file(repair_files.BYTE_BPE).encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows)


def test_buckets_keep_the_order_of_ids():
    rng = np.random.default_rng(3)
    cuts = np.array([2, 5, 5, 5, 9])
    ids, crc = rng.integers(0, 12, 2000), rng.integers(0, 1 << 32, 2000)
    got = repair_files.buckets_of(cuts, ids, crc)
    order = np.lexsort((crc, ids))
    assert (np.diff(got[order]) >= 0).all() and set(got[ids == 5]) == {2, 3, 4}
