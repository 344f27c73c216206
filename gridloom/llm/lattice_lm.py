"""Language-model scoring by the marginal of a subword lattice.

The pieces of an existing subword vocabulary, with a blank that starts each
word, and all single bytes as fallback span a lattice over every word. The
model gives each piece a probability; a word's probability is the sum over all
its segmentations, by a forward recursion in log space, and a text's that of
its words and of one end. Weights begin from the vocabulary's scores and are
fitted to the training documents by expectation maximisation over the same
lattice (ROUNDS rounds, by forward and backward recursion).

Documents are read once: blocks of them are written with a dictionary of their
own, each document as numbers of its words. The dictionaries meet by word, which
gives the counts of all training documents and one scoring of each distinct
word, and the results go back to their blocks. What moves is the blocks'
distinct words and the numbered documents, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordStore, record, remainder, slices, utf8
from gridloom.llm.near_dedup import word_stretches
from gridloom.session import let_workers_import, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Rounds of expectation maximisation.
ROUNDS = 2
#: Added to each piece's expected count.
SMOOTHING = 0.01
#: Bytes of text in a block.
BLOCK_BYTES = 16_000_000
#: Bytes of a word whose arcs are held at once; a longer one goes through in windows, with the same result.
WINDOW = 2048

_CODED = "block long, seq int, word binary, n long, doc_id long, held_out boolean, tokens long, code binary"
_CODED_ARROW = pa.schema(
    [("block", pa.int64()), ("seq", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.int64()), ("code", pa.binary())]
)


class Lattice:
    """Pieces as bytes, with a blank for U+2581, and the recursions over many words at once."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        usable = [(p.piece.replace("▁", " ").encode(), p.score) for p in model.pieces if p.type == proto.ModelProto.SentencePiece.NORMAL]
        # a piece that holds a capital A-Z or more than one blank can't occur in a word
        usable = [(x, s) for x, s in usable if x == x.lower() and x.count(b" ") + (not x.strip()) <= 1 and b" " not in x[1:]]
        self.pieces = [bytes([b]) for b in range(256)] + [x for x, _ in usable if len(x) > 1 or x >= b"\x80"]
        self.end = len(self.pieces)
        score = {x: s for x, s in usable}
        rank = np.array([-score.get(x, -len(model.pieces)) for x in self.pieces])
        start = 1 / (np.clip(rank, 0, len(model.pieces)) + 10)
        self.first_guess = np.log(np.append(start, start.max()) / (start.sum() + start.max()))
        self.longest = max(map(len, self.pieces))
        self.sizes = sorted({len(x) for x in self.pieces})
        child: dict[tuple[int, int], int] = {}
        ends = {}
        for number, piece in enumerate(self.pieces):
            at = 0
            for b in piece:
                at = child.setdefault((at, b), len(child) + 1)
            ends[at] = number
        #: The trie of the pieces: next state by state and byte (0: none), and the piece that ends at a state.
        self.next, self.piece = np.zeros((len(child) + 1, 256), np.int32), np.full(len(child) + 1, -1, np.int32)
        for (at, b), to in child.items():
            self.next[at, b] = to
        self.piece[list(ends)] = list(ends.values())

    def arcs(self, words: np.ndarray, first: int, last: int) -> np.ndarray:
        """For words (rows of bytes) and ends first < j <= last: number of the piece of each size, or -1."""
        m, low = len(words), max(0, first - self.longest)
        width, out = last - low, np.full((m, last - first, len(self.sizes)), -1, np.int32)
        data = np.append(np.ascontiguousarray(words[:, low:last]).ravel(), np.uint8(0))
        at, column = np.arange(m * width), np.tile(np.arange(low, last), m)
        state = np.zeros(m * width, np.int32)
        for size in range(1, self.longest + 1):
            state = self.next[state, data[at + size - 1]]
            alive = np.flatnonzero((state > 0) & (column + size <= last))
            at, column, state = at[alive], column[alive], state[alive]
            if not len(at):
                break
            piece = self.piece[state]
            hit = np.flatnonzero((piece >= 0) & (column + size > first))
            if len(hit):
                out[at[hit] // width, column[hit] + size - first - 1, self.sizes.index(size)] = piece[hit]
            inside = column + size < last
            at, column, state = at[inside], column[inside], state[inside]
        return out

    def forward(self, words: np.ndarray, weights: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Log probability of each beginning of each word of equal length; kept: gets the arcs of a word of one window."""
        m, n = words.shape
        alpha = np.full((m, n + 1), -np.inf)
        alpha[:, 0] = 0.0
        sizes = np.array(self.sizes)
        padded = np.append(weights[:-1], -np.inf)  # number -1: no such piece
        with np.errstate(divide="ignore", invalid="ignore"):
            for a in range(0, n, WINDOW):
                b = min(n, a + WINDOW)
                arcs = self.arcs(words, a, b)
                if kept is not None and n <= WINDOW:
                    kept.append(arcs)
                for j in range(a + 1, b + 1):
                    usable = int(np.searchsorted(sizes, j, side="right"))
                    x = alpha[:, j - sizes[:usable]] + padded[arcs[:, j - a - 1, :usable]]
                    top = x.max(axis=1)
                    alpha[:, j] = np.log(np.exp(x - top[:, None]).sum(axis=1)) + top
        return alpha

    def score(self, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Log marginal probability of each word of equal length."""
        return self.forward(words, weights)[:, -1]

    def expected(self, words: np.ndarray, counts: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
        """Add to out how often each piece is expected in words that occur counts times; long words window by window, from the last."""
        m, n = words.shape
        kept: list[np.ndarray] = []
        alpha = self.forward(words, weights, kept)
        total = alpha[:, n]
        padded = np.append(weights[:-1], -np.inf)
        beta = np.full((m, n + 1), -np.inf)
        beta[:, n] = 0.0
        for a in range((n - 1) // WINDOW * WINDOW, -1, -WINDOW):
            b = min(n, a + WINDOW)
            arcs = kept[0] if kept else self.arcs(words, a, b)
            for j in range(b, a, -1):
                for s, size in enumerate(self.sizes):
                    if size > j:
                        break
                    own = arcs[:, j - a - 1, s]
                    at = np.flatnonzero(own >= 0)
                    if len(at):
                        w = padded[own[at]] + beta[at, j]
                        beta[at, j - size] = np.logaddexp(beta[at, j - size], w)
                        out += np.bincount(own[at], np.exp(alpha[at, j - size] + w - total[at]) * counts[at], len(out))

    def groups(self, words: list[bytes], cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices and bytes of words of equal length, with the blank before, some at a time."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                n = sizes[part[0]] + 1
                step = max(1, cells // n)
                for a in range(0, len(part), step):
                    own = part[a : a + step]
                    yield own, np.frombuffer(b"".join(b" " + words[i] for i in own.tolist()), np.uint8).reshape(len(own), n)


_LATTICE: dict[str, Lattice] = {}


def lattice(path: str = MODEL) -> Lattice:
    """This worker's lattice."""
    if path not in _LATTICE:
        _LATTICE[path] = Lattice(path)
    return _LATTICE[path]


def _code(block_bytes: int):
    """Rows of (doc_id, text, held_out) to rows of blocks: one a distinct word and one a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 16

        def block(parts: list[tuple], name: int) -> Iterator[pa.RecordBatch]:
            store, words = WordStore(1 << 62), []
            train, docs = np.zeros(0, np.int64), []
            for ids, held, texts in parts:
                met, counts = word_stretches(texts)
                own, new = store.numbers(met)
                words += [met.text(i) for i in new.tolist()]
                teach = np.repeat(~np.array(held, bool), counts)
                seen = np.bincount(own[teach], minlength=len(words))
                seen[: len(train)] += train
                train, at = seen, 0
                for doc_id, out, n in zip(ids, held, counts.tolist()):
                    seq, often = np.unique(own[at : at + n], return_counts=True)
                    docs.append((doc_id, out, n, seq.astype("<u4").tobytes() + often.astype("<u4").tobytes()))
                    at += n
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                m = len(part)
                none = [pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.binary())]
                yield record(_CODED_ARROW, [name] * m, range(a, a + m), part, train[a : a + m], *none)
            for a in range(0, len(docs), 10_000):
                part = docs[a : a + 10_000]
                m = len(part)
                yield record(_CODED_ARROW, [name] * m, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), *zip(*part))

        parts, have = [], 0
        for batch in slices(batches, 1):
            texts = utf8(batch.column(1))
            parts.append((batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts))
            have += sum(map(len, texts))
            if have >= block_bytes:
                yield from block(parts, number)
                parts, have, number = [], 0, number + 1
        if parts:
            yield from block(parts, number)

    return run


_PLACED = "word binary, c long, first boolean, blocks array<long>, seqs array<int>"
#: Places in a row of a word.
PLACES = 8192


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n, block, seq) in the order of words to rows of at most PLACES places with the word's whole count."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("first", pa.bool_()), ("blocks", pa.list_(pa.int64())), ("seqs", pa.list_(pa.int32()))])
    held: list[tuple] = []  # parts of the last word so far

    def rows(word: pa.Array, start: np.ndarray, n: np.ndarray, block: np.ndarray, seq: np.ndarray) -> pa.RecordBatch:
        """start: where words begin, and the end."""
        size = np.diff(start)
        parts = -(-size // PLACES)
        of = np.repeat(np.arange(len(size)), parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts = pa.array(np.append(start[:-1][of] + part * PLACES, start[-1]), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (block, seq)]
        return record(schema, word.take(pa.array(start[:-1][of])), np.add.reduceat(n, start[:-1])[of], part == 0, *lists)

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            n, block, seq = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            word, total = pa.array([held[0][0]], pa.binary()), n.sum()
            for a in range(0, len(n), PLACES):
                part = slice(a, a + PLACES)
                yield record(schema, word, [total], [a == 0], [block[part].tolist()], [seq[part].tolist()])
            held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        word, (n, block, seq) = batch.column(0).cast(pa.binary()), (batch.column(i).to_numpy() for i in (1, 2, 3))
        new = np.concatenate([[True], pa.compute.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)]) if len(word) > 1 else np.array([True])
        start = np.flatnonzero(new)
        last = int(start[-1])
        if held and held[0][0] == word[0].as_py():
            stop = int(start[1]) if len(start) > 1 else len(word)
            held.append((held[0][0], n[:stop], block[:stop], seq[:stop]))
            start = start[1:]
            if not len(start):
                continue
        yield from close()
        if len(start) > 1:
            yield rows(word, start, n[:last], block[:last], seq[:last])
        held.append((word[last].as_py(), n[last:], block[last:], seq[last:]))
    yield from close()


def fit(vocabulary: DataFrame, ends: int, path: str = MODEL, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Natural log weights of the pieces and the end, fitted to words (word, c) and ends documents."""
    own = lattice(path)
    weights = own.first_guess
    schema = pa.schema([("piece", pa.int32()), ("expected", pa.float64())])
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            mine = lattice(path)
            out = np.zeros(len(mine.pieces))
            for batch in batches:
                words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for at, rows in mine.groups(words):
                    mine.expected(rows, counts[at], weights, out)
            used = np.flatnonzero(out)
            yield record(schema, used.astype(np.int32), out[used])

        sums = vocabulary.where("first and c > 0").select("word", "c").mapInArrow(run, "piece int, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).collect()
        total = np.full(len(own.pieces) + 1, smoothing)
        for r in sums:
            total[r["piece"]] += r["expected"]
        total[own.end] += ends
        weights = np.log(total / total.sum())
    return weights


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_ENTRY = np.dtype([("seq", "<u4"), ("c", "<f8"), ("score", "<f8")])


def score_documents(docs: DataFrame, modulus: int = 5, held_out: int = 1, path: str = MODEL, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log probabilities of all whole texts, a row a document.

    Learns from documents whose crc32(doc_id as text) mod modulus is not
    held_out. Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one
    end. base_score is the smoothed unigram score of words; score the log10
    marginal of the piece lattice. n_known counts tokens seen in training.

    Null text counts as empty: only the end. Null ids count as empty text in the
    fold and are returned as null; repeated rows are counted and scored each;
    other columns are not read; no rows give no rows. Without training rows
    every token is unknown and the pieces keep their first weights.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    out = remainder(F.col(id_col), modulus) == held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), out.alias("held_out"))
    coded, _ = written(rows.mapInArrow(_code(block_bytes), _CODED), "coded")
    words = coded.where("word is not null").select("word", "n", "block", "seq")
    vocabulary, _ = written(words.repartition("word").sortWithinPartitions("word").mapInArrow(_gather, _PLACED), "vocabulary")
    tokens, kinds = vocabulary.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = coded.where("code is not null and not held_out").count()
    weights = fit(vocabulary, ends, path, rounds) if ends else lattice(path).first_guess
    total, distinct = tokens + ends, kinds + (ends > 0)
    base = lambda c: np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    end_base, end_score = float(base(ends)), float(weights[-1] / np.log(10))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        schema = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            texts, blocks = batch.column(0).to_pylist(), batch.column(2)
            value = np.empty(len(texts))
            for at, part in own.groups(texts):
                value[at] = own.score(part, weights) / np.log(10)
            size = pa.compute.list_value_length(blocks).to_numpy()
            block = blocks.flatten().to_numpy()
            entry = np.empty(len(block), _ENTRY)
            entry["seq"], entry["c"], entry["score"] = batch.column(3).flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), size), np.repeat(value, size)
            order = np.argsort(block, kind="stable")
            block, entry = block[order], entry[order]
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist() + [len(block)] if len(block) else [0]
            yield record(schema, [int(block[a]) for a in cuts[:-1]], [entry[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of (block, words before documents)."""
        block, payloads, c, value = None, [], None, None
        for batch in batches:
            done = []
            for b, payload, doc_id, held, n, code in zip(*(x.to_pylist() for x in batch.columns)):
                if b != block:
                    block, payloads, c, value = b, [], None, None
                if payload is not None:
                    payloads.append(payload)
                    continue
                if c is None:
                    entry = np.frombuffer(b"".join(payloads), _ENTRY)
                    payloads = []
                    c, value = np.zeros(len(entry)), np.zeros(len(entry))
                    c[entry["seq"]], value[entry["seq"]] = entry["c"], entry["score"]
                    unigram = base(c)
                seq, often = np.frombuffer(code, "<u4").reshape(2, -1)
                known = int(often[c[seq] > 0].sum()) + (ends > 0)
                done.append((doc_id, held, n + 1, known, total, float(often @ unigram[seq]) + end_base, float(often @ value[seq]) + end_score))
            if done:
                yield record(_OUT_ARROW, *zip(*done))

    entries = vocabulary.select("word", "c", "blocks", "seqs").mapInArrow(score, "block long, payload binary")
    nothing = lambda *types: [F.lit(None).cast(t) for t in types]
    entries = entries.select("block", "payload", *(x.alias(n) for x, n in zip(nothing("long", "boolean", "long", "binary"), ("doc_id", "held_out", "tokens", "code"))))
    numbered = coded.where("code is not null").select("block", F.lit(None).cast("binary").alias("payload"), "doc_id", "held_out", "tokens", "code")
    both = entries.union(numbered).repartition("block").sortWithinPartitions("block", F.col("payload").isNull())
    return both.mapInArrow(finish, _OUT)
