"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns find emails, IP addresses, payment cards and phone numbers.
The field adds spans that the patterns miss (other separators, missing plus
signs). It labels whole segments of a region of text: a segment's score comes
from features of the whole span (its shape, its number of digits, check digits,
octets, what stands beside it) and from the labels of neighbouring segments.
Dynamic programming over segments of at most LONGEST tokens chooses boundaries
and types jointly. Text that holds no digit and no ``@`` can't hold a span, so
that only regions around those are decoded; this loses nothing.

The field is trained by gradient ascent on the conditional likelihood of the
base spans in a bounded sample of regions (EXAMPLES for each kind and for none,
those with the smallest hash), and of the same spans rewritten in other formats.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import first_of_each, record, slices, strings
from gridloom.session import let_workers_import

KINDS = ("email", "ip", "card", "phone")
#: Tokens in a segment at most, as far as it isn't found by a pattern.
LONGEST = 24
#: Regions for training, for each kind and for regions without a span.
EXAMPLES = 120
#: Characters of a region for training at most; decoding knows no such bound.
EXAMPLE_CHARS = 200
EPOCHS = 6
#: A span is added only if it scores so much more than no span.
MARGIN = 1.0

Span = tuple[int, int, int]

_TRIGGER = re.compile("[0-9@]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns as (kind, start, end), by kind and then start."""
    if not _TRIGGER.search(text):
        return []
    spans = [(0, a, b) for a, b in _emails(text)]
    spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return spans


#: Runs of what numbers are written with; each gives one region at most, so that reading takes linear time.
_RUN = re.compile("[0-9 ().+-]++")
_DIGIT = re.compile("[0-9]")
_AFTER_AT = re.compile("@ ?[A-Za-z0-9.-]*+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]", re.DOTALL)
_PIECES = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)


def regions(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches, in order, outside which no segment can lie.

    From the first digit of a run, with the signs and brackets before it, to its
    last digit; and around each @ the characters of an address.
    """
    if not _TRIGGER.search(text):
        return []
    found = []
    for m in _RUN.finditer(text):
        if digit := _DIGIT.search(text, m.start(), m.end()):
            run, first = m[0].rstrip(" ().+-"), digit.start() - m.start()
            before = len(run[:first].rstrip("+("))
            found.append((m.start() + before, m.start() + len(run)))
    if "@" in text:
        found += [_email_region(text, m.start()) for m in re.finditer("@", text)]
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _email_region(text: str, at: int) -> tuple[int, int]:
    """The characters of an address around one @; those before it hold no other @."""
    a = at - 1 if at and text[at - 1] == " " else at
    while a and text[a - 1] in _LOCAL:
        a -= 1
    return a, _AFTER_AT.match(text, at).end()


def _beside(c: str) -> str:
    return "^" if not c else "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


def span_features(span: str, left: str, right: str) -> list[str]:
    """Features of a whole span between the characters left and right of it."""
    digits = _digits(span)
    shape = "".join("9" if x[0].isdigit() else "a" if x[0].isalpha() else x for x in _PIECES.findall(span[:64]))
    groups = [len(x) for x in re.findall("[0-9]+", span[:64])]
    out = ["bias", f"shape {shape}", f"digits {min(len(digits), 20)}", f"first {_beside(span[0])}", f"last {_beside(span[-1])}", f"left {_beside(left)}", f"right {_beside(right)}", f"groups {' '.join(map(str, groups[:8]))}"]
    if "@" in span:
        name, _, domain = span.partition("@")
        out += ["at", f"named {bool(name.strip())}", f"dotted {'.' in domain.strip('. ')}", f"spaced {' ' in span}"]
    if span[0] == "+":
        out.append("plus")
    if 16 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits)}")
    if span.count(".") == 3 and len(groups) == 4:
        out.append(f"octets {all(map(_octet, re.findall('[0-9]+', span)))}")
    return out


class Field:
    """Weights of the semi-Markov field. Label 0 is none, label k + 1 is kind k."""

    def __init__(self, weights: dict[tuple[str, int], float] | None = None, steps: np.ndarray | None = None):
        self.weights = weights or {}
        self.steps = np.zeros((len(KINDS) + 1, len(KINDS) + 1)) if steps is None else steps
        self.known: dict[tuple[str, str, str], list[float]] = {}

    def scores(self, span: str, left: str, right: str) -> list[float]:
        """Score of each kind."""
        key = span, _beside(left), _beside(right)
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            w, features = self.weights, span_features(span, left, right)
            self.known[key] = [sum(w.get((f, k), 0.0) for f in features) for k in range(len(KINDS))]
        return self.known[key]


def segments(region: str) -> tuple[list[int], list[list[tuple[int, str]]]]:
    """Token bounds of a region and, for each end, the candidate segments (first token, text) that end there."""
    tokens = _TOKEN.findall(region)
    bounds = [0]
    for t in tokens:
        bounds.append(bounds[-1] + len(t))
    ends: list[list[tuple[int, str]]] = [[] for _ in bounds]
    for j in range(1, len(bounds)):
        if not tokens[j - 1][0].isalnum():
            continue
        for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
            if tokens[i][0].isspace():
                continue
            span = region[bounds[i] : bounds[j]]
            if len(span) > 128:
                break
            if "@" in span:
                if span.count("@") == 1 and tokens[i] != "@" and span.count(" ") <= 2:
                    ends[j].append((i, span))
            elif (tokens[i][0].isdigit() or tokens[i] in "+(") and not any(c.isalpha() for c in span) and sum("0" <= c <= "9" for c in span) >= 4:
                ends[j].append((i, span))
    return bounds, ends


def _lse(x: np.ndarray, axis=None):
    m = x.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - m).sum(axis=axis, keepdims=True)) + m
    return out.reshape(()) if axis is None else np.squeeze(out, axis)


def decode(field: Field, region: str, left: str, right: str) -> list[Span]:
    """The best segmentation's spans in a region between two characters; offsets in the region."""
    bounds, ends = segments(region)
    if not any(ends):
        return []
    n, labels = len(bounds) - 1, len(KINDS) + 1
    best = np.full((n + 1, labels), -np.inf)
    back: list[list[tuple[int, int] | None]] = [[None] * labels for _ in range(n + 1)]
    best[0, 0] = 0.0
    for j in range(1, n + 1):
        for i, y, score in _arcs(field, region, bounds, ends, j, left, right):
            via = best[i] + field.steps[:, y]
            p = int(via.argmax())
            if (total := via[p] + score - (MARGIN if y else 0)) > best[j, y]:
                best[j, y], back[j][y] = total, (i, p)
    j, y = n, int((best[n] + field.steps[:, 0]).argmax())
    out = []
    while j:
        i, p = back[j][y]
        if y:
            out.append((y - 1, bounds[i], bounds[j]))
        j, y = i, p
    return out[::-1]


def _arcs(field: Field, region: str, bounds: list[int], ends: list, j: int, left: str, right: str) -> Iterator[tuple[int, int, float]]:
    """Segments that end at token j: (first token, label, score)."""
    yield j - 1, 0, 0.0
    after = region[bounds[j]] if bounds[j] < len(region) else right
    for i, span in ends[j]:
        before = region[bounds[i] - 1] if bounds[i] else left
        for k, score in enumerate(field.scores(span, before, after)):
            yield i, k + 1, score


class Example:
    """A region of text with its true segments, laid out for training: all that doesn't change with the weights.

    Candidates in the order of their ends: first token, features (numbers), and
    for each end where its candidates begin.
    """

    def __init__(self, number: dict[str, int], region: str, left: str, right: str, gold: dict[tuple[int, int], int]):
        bounds, ends = segments(region)
        at = {b: t for t, b in enumerate(bounds)}
        self.n = len(bounds) - 1
        self.first = np.array([i for own in ends for i, _ in own], np.int64)
        self.cut = np.cumsum([0, *(len(own) for own in ends)])
        rows = []
        for j, own in enumerate(ends):
            for i, span in own:
                before, after = region[bounds[i] - 1] if bounds[i] else left, region[bounds[j]] if bounds[j] < len(region) else right
                rows.append([number.setdefault(f, len(number)) for f in span_features(span, before, after)])
        self.flat = np.array([f for r in rows for f in r], np.int64)
        self.row = np.cumsum([0, *(len(r) for r in rows)])[:-1]
        self.size = np.array([len(r) for r in rows], np.int64)
        self.path: list[tuple[int, int, int]] | None = []  # (first token, end token, label) of the true segments
        place = 0
        for (a, b), y in sorted(gold.items()):
            found = [c for c in range(*self.cut[at[b] : at[b] + 2]) if self.first[c] == at[a]] if a in at and b in at and at[a] >= place else []
            if not found:
                self.path = None
                break
            self.path.append((at[a], at[b], y))
            place = at[b]

    def gradient(self, weights: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected labels of each candidate (candidates x kinds), and label pairs."""
        labels, n = len(KINDS) + 1, self.n
        scores = np.add.reduceat(weights[self.flat], self.row, axis=0) if len(self.row) else np.zeros((0, len(KINDS)))
        alpha, beta = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
        alpha[0, 0], beta[n] = 0.0, steps[:, 0]
        for j in range(1, n + 1):
            alpha[j, 0] = _lse(alpha[j - 1] + steps[:, 0])
            a, b = self.cut[j], self.cut[j + 1]
            if b > a:
                via = _lse(alpha[self.first[a:b], :, None] + steps[None, :, 1:], axis=1) + scores[a:b]
                alpha[j, 1:] = _lse(via, axis=0)
        total = float(_lse(alpha[n] + beta[n]))
        mass, pairs = np.zeros((len(self.first), len(KINDS))), np.zeros_like(steps)
        pairs[:, 0] -= np.exp(alpha[n] + beta[n] - total)
        for j in range(n, 0, -1):
            reach = steps[:, 0] + beta[j, 0]
            pairs[:, 0] -= np.exp(alpha[j - 1] + reach - total)
            beta[j - 1] = np.logaddexp(beta[j - 1], reach)
            a, b = self.cut[j], self.cut[j + 1]
            if b > a:
                reach = steps[None, :, 1:] + (scores[a:b] + beta[j, 1:])[:, None, :]
                share = np.exp(alpha[self.first[a:b], :, None] + reach - total)
                pairs[:, 1:] -= share.sum(axis=0)
                mass[a:b] = -share.sum(axis=1)
                rows = self.first[a:b]  # each token begins one candidate of an end at most
                beta[rows] = np.logaddexp(beta[rows], _lse(reach, axis=2))
        place, previous = 0, 0
        for i, j, y in [*self.path, (n, n, 0)]:
            if i > place:
                pairs[previous, 0] += 1
                pairs[0, 0] += i - place - 1
                previous = 0
            if y:
                found = next(c for c in range(self.cut[j], self.cut[j + 1]) if self.first[c] == i)
                mass[found, y - 1] += 1
                pairs[previous, y] += 1
                place, previous = j, y
        pairs[previous, 0] += 1
        return mass, pairs


def rewritten(region: str, gold: dict[tuple[int, int], int]) -> list[tuple[str, dict[tuple[int, int], int]]]:
    """A region's only span in formats that the patterns don't know."""
    if len(gold) != 1:
        return []
    ((a, b), y), = gold.items()
    span, digits = region[a:b], _digits(region[a:b])
    other = {
        1: [span.replace("@", " @ ", 1)],
        3: [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))],
        4: [f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}"] if len(digits) >= 10 else [],
    }.get(y, [])
    return [(region[:a] + x + region[b:], {(a, a + len(x)): y}) for x in other]


#: Dates and times: number regions without personal data, in case the sample has none.
_PLAIN_REGIONS = ("2024-01-02", "2024-01-02 10", "2023-11-30 23", "1999-12-31", "01.02.2024", "31-12-2023", "2019-05-17 08", "12-10-2020 14")


def fit(examples: list[tuple[str, str, str, dict[tuple[int, int], int]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 0.002) -> Field:
    """Adaptive gradient ascent over the examples in a fixed order."""
    number: dict[str, int] = {}
    work = [(r, left, right, g) for region, left, right, gold in examples for r, g in [(region, gold), *rewritten(region, gold)]]
    work += [(r, " ", ":" if r[-3:-2] == " " else " ", {}) for r in _PLAIN_REGIONS]
    laid = [x for x in (Example(number, *w) for w in work) if x.path is not None]
    weights, seen = np.zeros((len(number), len(KINDS))), np.full((len(number), len(KINDS)), 1e-6)
    steps = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
    seen_steps = np.full_like(steps, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for x in order.permutation(len(laid)):
            own = laid[x]
            mass, pairs = own.gradient(weights, steps)
            used, which = np.unique(own.flat, return_inverse=True)
            g = np.zeros((len(used), len(KINDS)))
            np.add.at(g, which, np.repeat(np.where(np.abs(mass) > 1e-6, mass, 0.0), own.size, axis=0))
            g = np.where(g != 0, g - decay * weights[used], 0.0)
            seen[used] += g * g
            weights[used] += rate * g / np.sqrt(seen[used])
            seen_steps += pairs**2
            steps = steps + rate * pairs / np.sqrt(seen_steps)
    return Field({(f, k): float(w) for f, i in number.items() for k, w in enumerate(weights[i]) if w}, steps)


def _gold(spans: list[Span], a: int, b: int) -> dict[tuple[int, int], int]:
    """Labels of a region's base spans; of overlapping ones the longer, then the earlier kind."""
    out: dict[tuple[int, int], int] = {}
    for k, s, e in sorted((x for x in spans if a <= x[1] and x[2] <= b), key=lambda x: (x[1] - x[2], x[0])):
        if all(e <= s2 or s >= e2 for s2, e2 in out):
            out[s - a, e - a] = k + 1
    return out


_EXAMPLE = "kind int, hash binary, region string, before string, after string, labels array<int>"
_EXAMPLE_ARROW = pa.schema([("kind", pa.int32()), ("hash", pa.binary()), *((x, pa.string()) for x in ("region", "before", "after")), ("labels", pa.list_(pa.int32()))])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition, the few regions of each kind with the smallest hash."""
    kept: dict[int, dict[tuple, tuple]] = defaultdict(dict)
    for batch in slices(batches, 0):
        for text in strings(batch.column(0)):
            if found := regions(text):
                spans = base_spans(text)
                for a, b in found:
                    if b - a <= EXAMPLE_CHARS:
                        gold = _gold(spans, a, b)
                        digest = hashlib.blake2b(text[max(0, a - 40) : b + 40].encode("utf-8", "replace"), digest_size=8).digest()
                        labels = [x for (s, e), y in sorted(gold.items()) for x in (s, e, y)]
                        kept[min(gold.values(), default=0)][digest, text[a:b]] = (text[a - 1 : a], text[b : b + 1], labels)
        for kind, own in kept.items():
            if len(own) > EXAMPLES:
                kept[kind] = dict(sorted(own.items())[:EXAMPLES])
    rows = [(kind, digest, region, *rest) for kind, own in kept.items() for (digest, region), rest in own.items()]
    if rows:
        yield record(_EXAMPLE_ARROW, *zip(*rows))


def train(docs: DataFrame, text_col: str = "text", examples: int = EXAMPLES) -> Field:
    """Fit on a bounded sample of regions; an empty field if there are none."""
    let_workers_import(docs.sparkSession)
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_examples, _EXAMPLE)
    rows = first_of_each(found.dropDuplicates(["kind", "hash", "region"]), "kind", ["hash", "region"], examples).collect()
    rows.sort(key=lambda r: (bytes(r["hash"]), r["region"]))
    take = [(r["region"], r["before"], r["after"], {(a, b): y for a, b, y in zip(*[iter(r["labels"])] * 3)}) for r in rows]
    return fit(take)


class Cover:
    """Which characters some spans cover, as disjoint stretches in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda x: (x[1], x[2])):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        at = bisect_right(self.ends, a)
        return at < len(self.starts) and self.starts[at] < b


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans, and those with what the field adds beside them; both by kind and then start."""
    base = base_spans(text)
    if not field.weights:
        return base, base
    added, cover, exact = [], Cover(base), {x[1:] for x in base}
    for a, b in regions(text):
        if (a, b) in exact:
            continue
        for k, s, e in decode(field, text[a:b], text[a - 1 : a], text[b : b + 1]):
            if not cover.meets(a + s, a + e):
                added.append((k, a + s, a + e))
    return base, sorted([*base, *added])


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_OUT_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")] + [("base_sha256", pa.string()), ("spans", pa.string())])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Personal data in each whole text, a row a document.

    doc_id, the numbers of base spans of each kind, the SHA-256 of the base
    spans as ``kind:start:end`` joined by commas, and all spans so joined (code
    points, end exclusive). Null text counts as empty and has none. Null ids
    pass through, repeated rows are read each, other columns are not read, no
    rows give no rows. Without a field one is trained on docs. Of paths of equal
    score to a token and label, that whose last segment begins last is taken, then
    that with the smaller label before (none, then the kinds as listed).
    """
    let_workers_import(docs.sparkSession)
    field = train(docs, text_col) if field is None else field
    weights, steps = dict(field.weights), field.steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights, steps)
        for batch in slices(batches, 1):
            both = [all_spans(t, own) for t in strings(batch.column(1))]
            counts = [[sum(x[0] == k for x in base) for base, _ in both] for k in range(len(KINDS))]
            yield record(_OUT_ARROW, batch.column(0), *counts, [hashlib.sha256(written_spans(b).encode()).hexdigest() for b, _ in both], [written_spans(x) for _, x in both])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _OUT)


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join(out) + text[at:] if out else text


def redact_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", field: Field | None = None) -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets.

    All columns as they are, but for the text and, where there is such a column,
    its number of characters in rows whose text changed. Null texts stay null.
    """
    let_workers_import(docs.sparkSession)
    field = train(docs, text_col) if field is None else field
    weights, steps = dict(field.weights), field.steps
    at, size = docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights, steps)
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            new = [None if t is None else redact(t, all_spans(t, own)[1]) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size >= 0:
                sizes = [s if t == n else len(n) for s, t, n in zip(columns[size].to_pylist(), texts, new)]
                columns[size] = pa.array(sizes, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
