import hashlib
import random
import re
import time

import numpy as np
import pytest

from gridloom.llm import pii_semicrf as pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
CARD = "4111 1111 1111 1111"


def naive(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            bad = (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits))) or (k == 3 and not 8 <= len(digits) <= 15)
            if not bad:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(2)
    pieces = list("ab1234567890..@@+-_% ()\n") + [CARD, "a.b@c.de", "10.0.0.255", "256.1.1.1", "+1 (443) 555-5793", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == naive(text)


@pytest.mark.parametrize("text", ["1" * 200_000, "+1" + " " * 100_000, "a" * 200_000 + "@", "1." * 50_000, "@" * 50_000, "+1 " * 30_000, "1" + "(" * 200_000, "a" * 200_000 + "@" * 10, "10.0.0.1 " * 20_000, "a@b.co " * 25_000, "(" * 200_000 + "1"])
def test_long_runs_take_linear_time(field, text):
    began = time.process_time()
    pii.all_spans(text, field)
    assert time.process_time() - began < 60


@pytest.mark.parametrize("text", ["1(" * 50, "5" + "(" * 40, "(+(5 - 6)) .", "x@", "a.b @ c.d", "a@ b @c", "@@ a@b.c@d.e", "+1 (443) 555", "5 a@b.c 6@d.e", "+ ( -"])
def test_regions_hold_what_the_plain_patterns_find(text):
    plain = [m.span() for p in (r"[+(]*[0-9](?:[0-9 ().+-]*[0-9])?", r"[A-Za-z0-9._%+-]* ?@ ?[A-Za-z0-9.-]*") for m in re.finditer(p, text)]
    joined = []
    for a, b in sorted(plain):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    assert pii.regions(text) == joined


def test_cover():
    rng = random.Random(5)
    for _ in range(300):
        spans = [(0, a, a + rng.randrange(1, 6)) for a in (rng.randrange(40) for _ in range(rng.randrange(6)))]
        a = rng.randrange(40)
        b = a + rng.randrange(1, 6)
        assert pii.Cover(spans).meets(a, b) == any(x < b and a < y for _, x, y in spans)


def test_gradient_is_that_of_the_likelihood():
    """Against differences of the log-likelihood, by summing over all segmentations one by one."""
    rng = np.random.default_rng(4)
    region, left, right, gold = "a@b.co 1.2", " ", "x", {(0, 6): 1}
    number: dict = {}
    example = pii.Example(number, region, left, right, gold)
    weights, steps = rng.normal(0, 0.3, (len(number), 4)), rng.normal(0, 0.3, (5, 5))

    def likelihood(weights, steps):
        scores = [sum(weights[f] for f in example.flat[a : a + n]) for a, n in zip(example.row, example.size)]
        arcs = {j: [(j - 1, 0, 0.0)] + [(int(example.first[c]), k + 1, scores[c][k]) for c in range(example.cut[j], example.cut[j + 1]) for k in range(4)] for j in range(1, example.n + 1)}

        def total(j, label):  # of segmentations up to j that end with label
            return float(label == 0) if j == 0 else sum(total(i, y) * np.exp(steps[y, label] + s) for i, own, s in arcs[j] if own == label for y in range(5))

        (i, j, y), = example.path
        c = next(c for c in range(example.cut[j], example.cut[j + 1]) if example.first[c] == i)
        gaps = example.n - j
        true = steps[0, y] + scores[c][y - 1] + (steps[y, 0] + (gaps - 1) * steps[0, 0] if gaps else 0) + (steps[0, 0] if gaps else steps[y, 0])
        return true - np.log(sum(total(example.n, y) * np.exp(steps[y, 0]) for y in range(5)))

    mass, pairs = example.gradient(weights, steps)
    by_feature = np.zeros_like(weights)
    np.add.at(by_feature, example.flat, np.repeat(mass, example.size, axis=0))
    for _ in range(12):
        f, k, a, b = rng.integers(len(number)), rng.integers(4), rng.integers(5), rng.integers(5)
        for x, at, want in ((weights, (f, k), by_feature[f, k]), (steps, (a, b), pairs[a, b])):
            x[at] += 1e-5
            up = likelihood(weights, steps)
            x[at] -= 2e-5
            down = likelihood(weights, steps)
            x[at] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(want, abs=1e-4)


def samples():
    rng = random.Random(1)
    out = []
    for i in range(160):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        out += [f"write to some.{i}@mail{i % 9}.example.com now", f"from {rng.randrange(256)}.{rng.randrange(256)}.{i % 256}.9 it came", f"paid with {card} then", f"call +1 ({200 + i}) 555-{1000 + i} or", f"in {1900 + i} there were {i * 37} of {i}.5 and {10**15 + i * 7}"]
    return out


@pytest.fixture(scope="module")
def field():
    rows = []
    for t in samples():
        base = pii.base_spans(t)
        rows += [(t[a:b], t[a - 1 : a], t[b : b + 1], pii._gold(base, a, b)) for a, b in pii.regions(t)]
    return pii.fit(rows[:400])


def test_the_field_finds_base_spans_by_itself(field):
    right = total = 0
    for t in samples()[400:]:
        for a, b in pii.regions(t):
            gold = pii._gold(pii.base_spans(t), a, b)
            found = {(s, e): k + 1 for k, s, e in pii.decode(field, t[a:b], t[a - 1 : a], t[b : b + 1])}
            right += sum(found.get(s) == y for s, y in gold.items())
            total += len(gold)
    assert total > 100 and right / total > 0.95


@pytest.mark.parametrize("text, span", [("call 443-555-5793 now", "phone:5:17"), ("x me @ mail4.example.com x", "email:2:24"), ("x 4111.1111.1111.1111 x", "card:2:21")])
def test_the_field_adds_other_formats(field, text, span):
    assert pii.written_spans(pii.all_spans(text, field)[1]) == span


@pytest.mark.parametrize("text", ["on 2024-01-02 10:33 we", "about 3.14 or 1000000 of 12", "no numbers at all", "chapter 7, page 1234"])
def test_plain_numbers_stay(field, text):
    assert pii.all_spans(text, field) == ([], [])


def test_best_path_is_the_best_of_all_segmentations(field):
    region, left, right = "1 (443) 555-5793 10.0.0.1", " ", " "
    bounds, ends = pii.segments(region)
    n = len(bounds) - 1

    def best(j, label):
        if j == 0:
            return 0.0 if label == 0 else float("-inf")
        return max((best_any(i, label) + s - (pii.MARGIN if label else 0) for i, y, s in pii._arcs(field, region, bounds, ends, j, left, right) if y == label), default=float("-inf"))

    memo = {}

    def best_any(i, label):
        if (i, label) not in memo:
            memo[i, label] = max(best(i, y) + field.steps[y, label] for y in range(5))
        return memo[i, label]

    want = max(best(n, y) + field.steps[y, 0] for y in range(5))
    spans, score, previous, at = pii.decode(field, region, left, right), 0.0, 0, 0
    for k, s, e in spans:
        while bounds[at] < s:
            score, previous, at = score + field.steps[previous, 0], 0, at + 1
        score += field.steps[previous, k + 1] - pii.MARGIN + field.scores(region[s:e], region[s - 1 : s] or left, region[e : e + 1] or right)[k]
        previous, at = k + 1, bounds.index(e)
    while at < n:
        score, previous, at = score + field.steps[previous, 0], 0, at + 1
    assert score + field.steps[previous, 0] == pytest.approx(want)


def test_table(docs_of, field):
    rows = [(1, None), (2, ""), (3, f"{CARD} a@b.co"), (3, f"{CARD} a@b.co"), (None, "é +1 443 555 5793"), (5, "word " * 50_000 + "10.1.2.3")]
    got = pii.find_personal_data(docs_of(rows), field=field).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        base = naive(text)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[0] == k for x in base) for k in range(4)]
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(written.split(",")) <= set(r["spans"].split(","))
    assert pii.find_personal_data(docs_of([])).count() == 0
    assert pii.find_personal_data(docs_of(rows)).count() == len(rows)


def test_redaction(docs_of, field):
    docs = docs_of([(1, f"pay {CARD} to a@b.co."), (2, None), (3, "clean 12")])
    out = pii.redact_documents(docs, field=field)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: ("pay <card> to <email>.", 22), 2: (None, 0), 3: ("clean 12", 8)}
    assert pii.redact("abcdef", [(0, 1, 4), (1, 2, 5)]) == "a<email>f"
