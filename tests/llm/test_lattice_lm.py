import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm.lattice_lm import Lattice, score_documents


@pytest.fixture(scope="module")
def lattice():
    return Lattice()


def marginal(lattice, weights, word):
    """Sum over all segmentations by plain enumeration."""
    piece = {p: w for p, w in zip(lattice.pieces, weights)}

    def total(rest):
        return 1.0 if not rest else sum(math.exp(piece[rest[:k]]) * total(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in piece)

    return math.log(total(b" " + word))


@pytest.mark.parametrize("word", [b"the", b"unit", "né".encode(), b"x", "日".encode()])
def test_forward_is_the_sum_over_segmentations(lattice, word):
    row = np.frombuffer(b" " + word, np.uint8)[None, :]
    assert lattice.score(row, lattice.first_guess)[0] == pytest.approx(marginal(lattice, lattice.first_guess, word))


def test_windows_do_not_change_a_long_word(lattice, monkeypatch):
    row, counts = np.frombuffer(b" " + b"abcdefgh internationalisation" * 12, np.uint8)[None, :], np.array([2.0])
    whole, expected = lattice.score(row, lattice.first_guess), np.zeros(len(lattice.pieces))
    lattice.expected(row, counts, lattice.first_guess, expected)
    monkeypatch.setattr("gridloom.llm.lattice_lm.WINDOW", 7)
    parts = np.zeros(len(lattice.pieces))
    lattice.expected(row, counts, lattice.first_guess, parts)
    assert lattice.score(row, lattice.first_guess) == pytest.approx(whole) and np.allclose(parts, expected)


def test_arcs_are_all_pieces_that_end_there(lattice):
    words = [b" thinking", b" x\xc3\xa9\xff the"]
    for w in words:
        got = lattice.arcs(np.frombuffer(w, np.uint8)[None, :], 0, len(w))[0]
        for j in range(1, len(w) + 1):
            for s, size in enumerate(lattice.sizes):
                piece = w[j - size : j] if size <= j else None
                assert got[j - 1, s] == (lattice.pieces.index(piece) if piece in lattice.pieces else -1)


def test_expected_counts_add_up_to_the_word(lattice):
    out = np.zeros(len(lattice.pieces))
    lattice.expected(np.frombuffer(b" hello", np.uint8)[None, :], np.array([3.0]), lattice.first_guess, out)
    assert sum(n * len(p) for n, p in zip(out, lattice.pieces)) == pytest.approx(3 * len(" hello"))


def test_first_weights_are_a_distribution(lattice):
    assert np.exp(lattice.first_guess).sum() == pytest.approx(1)


def train(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def test_counts_and_base_score_against_plain_python(spark, docs_of):
    texts = ["The cat sat", "the CAT", None, "", " \t", "dog " * 50, "é日 x", "w" * 3000, "the cat sat"] * 4
    rows = [(i if i % 9 != 8 else 8, t) for i, t in enumerate(texts)] + [(None, "the end")]
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens) if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted((repr(i), not train(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 8)) for (i, _), ws in zip(rows, tokens))
    got = score_documents(docs_of(rows), block_bytes=400).collect()
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 8)) for r in got) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    by_text = {}
    for r, ((i, t), _) in zip(sorted(got, key=lambda r: repr(r["doc_id"])), sorted(zip(rows, tokens), key=lambda x: repr(x[0][0]))):
        by_text.setdefault(i, set()).add(round(r["score"], 6))


def test_a_word_of_more_places_than_a_row_holds(docs_of, monkeypatch):
    rows = [(i, f"the word{i % 7} the {'very' * (i % 3)}") for i in range(60)]
    order = lambda df: sorted(tuple(r) for r in df.collect())
    want = order(score_documents(docs_of(rows).repartition(3), block_bytes=100))
    monkeypatch.setattr("gridloom.llm.lattice_lm.PLACES", 2)
    got = order(score_documents(docs_of(rows).repartition(3), block_bytes=100))
    assert [x[:6] for x in got] == [x[:6] for x in want] and [x[6] for x in got] == pytest.approx([x[6] for x in want])


def test_words_that_a_sum_of_powers_confuses(docs_of):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(i, b if not train(i) else a) for i in range(6)]
    got = score_documents(docs_of(rows), rounds=0).collect()
    assert {r["n_known"] for r in got if r["held_out"]} == {1} and {r["n_known"] for r in got if not r["held_out"]} == {2}


def test_scores_against_plain_expectation_maximisation(docs_of, lattice):
    """Two rounds by enumerating every segmentation of every word."""
    texts = ["the tin", "at the inn", "Nit", "a tint", None, "then the ten"] * 2
    rows = list(enumerate(texts))
    words = [(t or "").lower().encode().split() for t in texts]
    counts = Counter(w for (i, _), ws in zip(rows, words) if train(i) for w in ws)
    ends = sum(train(i) for i, _ in rows)
    number = {p: k for k, p in enumerate(lattice.pieces)}

    def segmentations(rest):
        if not rest:
            yield []
        for k in range(1, len(rest) + 1):
            if rest[:k] in number:
                for tail in segmentations(rest[k:]):
                    yield [number[rest[:k]], *tail]

    every = {w: list(segmentations(b" " + w)) for ws in words for w in ws}
    weights = lattice.first_guess
    for _ in range(2):
        total = np.full(len(lattice.pieces) + 1, 0.01)
        for w, c in counts.items():
            shares = [math.exp(sum(weights[x] for x in s)) for s in every[w]]
            for s, share in zip(every[w], shares):
                for x in s:
                    total[x] += c * share / sum(shares)
        total[-1] += ends
        weights = np.log(total / total.sum())
    score = lambda ws: (sum(math.log(sum(math.exp(sum(weights[x] for x in s)) for s in every[w])) for w in ws) + weights[-1]) / math.log(10)
    got = {r["doc_id"]: r["score"] for r in score_documents(docs_of(rows), rounds=2).collect()}
    assert got == {i: pytest.approx(score(ws)) for (i, _), ws in zip(rows, words)}


def test_learning_helps_held_out_text(spark, docs_of):
    rows = [(i, f"word{i % 7} likes tokens and token{i % 5}") for i in range(200)]
    first = {r["doc_id"]: r["score"] for r in score_documents(docs_of(rows), rounds=0).collect()}
    later = [r for r in score_documents(docs_of(rows), rounds=2).collect() if r["held_out"]]
    assert later and all(r["score"] > first[r["doc_id"]] for r in later)


def test_empty_table(docs_of):
    assert score_documents(docs_of([])).count() == 0
