"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (a blank
before the text, U+2581 as a blank, all else as it is), the pieces (a trie
whose arcs read a piece's characters, and an arc back to the root that writes
its id and weighs it) and the byte fallback (an arc at the root that reads a
character which is no piece and writes the ids of its bytes). The last two are
joined at the root and composed with the normaliser once. The result is
composed with the texts, many at a time: every place of a text walks the trie
at once, and the piece arcs that are met are a lattice between places. Encoding
is the lattice's shortest path in the tropical semiring, by relaxing the arcs
in the order of their ends.

The models here are of the BPE kind, whose merges are no sum of piece scores.
Their result is still a path: a sequence of pieces is the result of the merges
exactly if every two neighbours are the result of the merges of their own
string. So the lattice is composed with one more transducer, whose state is the
last piece: it has an arc of weight 0 for such a pair and none for all others,
and every piece weighs 1. For unigram models neighbours are free and a piece
weighs its negative log score.

No piece reads a blank after another character; the lattice falls apart before
each run of blanks, and what lies between is solved once and kept (bounded).
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Stretches, record, slices, utf8
from gridloom.llm.tokens import IdStore
from gridloom.session import let_workers_import

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Stretches kept by a worker, and bytes of one that is kept.
KEPT = 1 << 19
LONGEST = 64
#: Neighbour pairs whose weight a worker keeps.
PAIRS_KEPT = 500_000
#: What the library subtracts from the least score of a unigram model for a character without a piece.
UNKNOWN = 10.0

_INFINITE = float("inf")
_META = "▁".encode()
#: Labels: 0 is nothing, a character is its code + 1; these two are any other character as it is, and as its bytes.
NOTHING, SAME, BYTES = 0, -1, -2
#: Written labels of pieces begin here, beyond all characters.
PIECE = 0x110001


def character(c: str) -> int:
    return ord(c) + 1


@dataclass
class Fst:
    """A weighted transducer: arcs[state] holds (read, write, weight, next); the start is state 0."""

    arcs: list[list[tuple[int, int, float, int]]] = field(default_factory=lambda: [[]])
    final: set[int] = field(default_factory=set)

    def state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1


def normaliser(prefix: bool) -> Fst:
    """U+2581 as a blank; with prefix a blank before any text that isn't empty."""
    out = Fst(final={0})
    body = out.state()
    out.final.add(body)
    steps = [(character("▁"), character(" "), 0.0, body), (SAME, SAME, 0.0, body)]
    out.arcs[body] = steps
    if prefix:
        begun = out.state()
        out.arcs[begun] = steps
        out.arcs[0] = [(NOTHING, character(" "), 0.0, begun)]
    else:
        out.arcs[0] = steps
    return out


def pieces_or_bytes(weights: dict[str, tuple[int, float]], fallback: float) -> Fst:
    """The loop over pieces (id and weight of each) and single characters that are no piece."""
    out = Fst(final={0})
    child: dict[tuple[int, str], int] = {}
    for piece, (number, weight) in weights.items():
        at = 0
        for c in piece:
            to = child.get((at, c))
            if to is None:
                to = child[at, c] = out.state()
                out.arcs[at].append((character(c), NOTHING, 0.0, to))
            at = to
        out.arcs[at].append((NOTHING, PIECE + number, weight, 0))
    for c, to in [(c, to) for (at, c), to in child.items() if at == 0 and c not in weights]:
        out.arcs[0].append((character(c), BYTES, fallback, 0))  # it begins a piece but is none
    out.arcs[0].append((SAME, BYTES, fallback, 0))
    return out


def compose(a: Fst, b: Fst) -> Fst:
    """What b makes of what a writes. SAME in a matches an own arc of b or, if b has none, b's SAME."""
    out, number, todo = Fst(), {(0, 0): 0}, [(0, 0)]

    def to(x: int, y: int) -> int:
        if (x, y) not in number:
            number[x, y] = out.state()
            todo.append((x, y))
        return number[x, y]

    while todo:
        x, y = todo.pop()
        own = out.arcs[number[x, y]]
        if x in a.final and y in b.final:
            out.final.add(number[x, y])
        known = {read for read, *_ in b.arcs[y]}
        taken = {read for read, *_ in a.arcs[x]}
        for read, write, weight, after in b.arcs[y]:
            if read == NOTHING:
                own.append((NOTHING, write, weight, to(x, after)))
        for read, write, weight, after in a.arcs[x]:
            if write == NOTHING:
                own.append((read, NOTHING, weight, to(after, y)))
                continue
            for read2, write2, weight2, after2 in b.arcs[y]:
                if write == SAME and read2 > NOTHING and read2 not in taken:
                    own.append((read2, write2, weight + weight2, to(after, after2)))
                elif read2 == write or (write > NOTHING and read2 == SAME and write not in known):
                    own.append((read, write if write2 == SAME else write2, weight + weight2, to(after, after2)))
    return out


def chain(text: str) -> Fst:
    """The acceptor of one text."""
    out = Fst()
    for c in text:
        out.arcs[-1].append((character(c), character(c), 0.0, len(out.arcs)))
        out.state()
    out.final.add(len(out.arcs) - 1)
    return out


def shortest_path(fst: Fst) -> list[int]:
    """Labels written on the path of least weight; the plain form, for one explicit transducer."""
    best, heap, back = {0: 0.0}, [(0.0, 0)], {}
    while heap:
        cost, at = heapq.heappop(heap)
        if cost > best[at]:
            continue
        for _, write, weight, to in fst.arcs[at]:
            if cost + weight < best.get(to, _INFINITE):
                best[to], back[to] = cost + weight, (at, write)
                heapq.heappush(heap, (cost + weight, to))
    at, out = min((x for x in fst.final if x in best), key=best.__getitem__), []
    while at in back:
        at, write = back[at]
        if write != NOTHING:
            out.append(write)
    return out[::-1]


class Transducer:
    """Normaliser, pieces and byte fallback of a model file, composed."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only identity normalisers with byte fallback are compiled")
        self.prefix = spec.add_dummy_prefix
        self.merges = model.trainer_spec.model_type == proto.TrainerSpec.BPE
        normal, byte = proto.ModelProto.SentencePiece.NORMAL, proto.ModelProto.SentencePiece.BYTE
        self.score = {p.piece.replace("▁", " "): p.score for p in model.pieces if p.type == normal}
        self.id = {p.piece.replace("▁", " "): i for i, p in enumerate(model.pieces) if p.type == normal}
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == byte}
        if any(" " in x.lstrip(" ") for x in self.id):
            raise ValueError("a piece reads a blank after another character")
        self.text = {i: x for x, i in self.id.items()}
        weights = {x: (i, 1.0 if self.merges else -self.score[x]) for x, i in self.id.items()}
        fallback = 1.0 if self.merges else UNKNOWN - min(self.score.values())
        self.body = compose(normaliser(False), pieces_or_bytes(weights, fallback))
        self.fallback, self.byte = fallback, np.array([byte_ids[b] for b in range(256)], np.uint32)
        self._lay_out()
        self.pairs: dict[int, bool] = {}
        out = [b""] * len(model.pieces)
        for x, i in self.id.items():
            out[i] = x.encode()
        for b, i in byte_ids.items():
            out[i] = bytes([b])
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_first = np.concatenate([[0], np.cumsum(self.out_size)[:-1]])
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)

    def _lay_out(self) -> None:
        """The composed transducer's arcs as arrays: steps by (state, character), and what each state writes on its way to the root."""
        arcs = self.body.arcs
        steps = sorted(((s << 21) | read, to) for s, own in enumerate(arcs) for read, write, _, to in own if read > NOTHING and write == NOTHING)
        self.step_key, self.step_to = np.array([k for k, _ in steps], np.int64), np.array([t for _, t in steps], np.int32)
        self.wrote, self.weight = np.full(len(arcs), -1, np.int32), np.zeros(len(arcs))
        for s, own in enumerate(arcs):
            for read, write, weight, _ in own:
                if read == NOTHING:
                    self.wrote[s], self.weight[s] = write - PIECE, weight
        # characters with a piece of their own never fall back to bytes
        self.single = np.zeros(0x110002, bool)
        single = [read for read, write, _, to in arcs[0] if read > NOTHING and write == NOTHING and self.wrote[to] >= 0]
        self.single[single] = True

    def merged(self, text: str) -> list[str]:
        """The merges' result: the best-scored pair first, of equals the leftmost, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -_INFINITE, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, pair: int) -> bool:
        """Whether the last transducer has an arc for a pair: (left piece + 1, 0 for the start or a byte) << 32 | right piece."""
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            want = [self.text[x] for x in ((pair >> 32) - 1, pair & 0xFFFFFFFF) if x >= 0]
            found = self.pairs[pair] = self.merged("".join(want)) == want
        return found

    def lattice(self, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs (from, to, piece or -1 for bytes, weight) of texts composed with the transducer.

        codes: the texts' characters, each text closed by -1; place: of each within its text.
        """
        n = len(codes)
        alive, state = np.flatnonzero(codes >= 0), np.zeros(n, np.int64)
        starts, ends, writes, weights = [], [], [], []
        none = alive[~self.single[codes[alive] + 1]]
        starts.append(none), ends.append(none + 1), writes.append(np.full(len(none), -1, np.int32)), weights.append(np.full(len(none), self.fallback))
        for step in range(n):
            alive = alive[codes[np.minimum(alive + step, n - 1)] >= 0]
            if not len(alive):
                break
            key = (state[alive] << 21) | (codes[alive + step] + 1)
            at = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            found = self.step_key[at] == key
            alive = alive[found]
            state[alive] = here = self.step_to[at[found]]
            done = self.wrote[here] >= 0
            starts.append(alive[done]), ends.append(alive[done] + step + 1), writes.append(self.wrote[here[done]]), weights.append(self.weight[here[done]])
        start, end, write, weight = (np.concatenate(x) for x in (starts, ends, writes, weights))
        order = np.lexsort((start, end, place[end]))
        return start[order], end[order], write[order], weight[order]

    def shortest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the shortest path of each text, one after the other, and their numbers; none may be empty."""
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.full(int(sizes.sum()) + len(texts), -1, np.int64)
        stop = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(codes), bool)
        inside[stop] = False
        codes[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        place = np.arange(len(codes)) - np.repeat(stop - sizes, sizes + 1)
        start, end, write, weight = self.lattice(codes, place)
        if len(texts) == 1:
            return self._trace(codes, stop, stop - sizes, *self._relaxed(start, end, write, weight, len(codes)))
        cost, last, back = np.full(len(codes), _INFINITE), np.full(len(codes), -1, np.int32), np.full(len(codes), -1, np.int64)
        cost[place == 0] = 0.0
        cuts = np.searchsorted(place[end], np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(cuts, cuts[1:]):
            own = np.arange(a, b)
            own = own[np.isfinite(cost[start[own]])]
            if self.merges:
                piece = own[write[own] >= 0]
                pairs, which = np.unique(((last[start[piece]].astype(np.int64) + 1) << 32) | write[piece], return_inverse=True)
                right = piece[np.array([self.fits(x) for x in pairs.tolist()], bool)[which]]
                own = np.sort(np.concatenate([right, own[write[own] < 0]]))
            if not len(own):
                continue
            total = cost[start[own]] + weight[own]
            order = np.lexsort((total, end[own]))
            own, total = own[order], total[order]
            first = np.concatenate([[True], end[own[1:]] != end[own[:-1]]])
            to = end[own[first]]
            cost[to], last[to], back[to] = total[first], write[own[first]], start[own[first]]
        return self._trace(codes, stop, stop - sizes, last, back)

    def _relaxed(self, start: np.ndarray, end: np.ndarray, write: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The last arc of the shortest path to each place of one text, arc by arc, as a long one has few that end together."""
        cost, last, back = [_INFINITE] * n, [-1] * n, [-1] * n
        cost[0] = 0.0
        for a, b, piece, w in zip(start.tolist(), end.tolist(), write.tolist(), weight.tolist()):
            if cost[a] + w < cost[b] and (piece < 0 or not self.merges or self.fits(((last[a] + 1) << 32) | piece)):
                cost[b], last[b], back[b] = cost[a] + w, piece, a
        return np.array(last, np.int32), np.array(back, np.int64)

    def _trace(self, codes: np.ndarray, stop: np.ndarray, begin: np.ndarray, last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers, from the ends of the paths back."""
        on = np.zeros(len(codes), bool)  # ends of arcs on the path
        at = stop[stop > begin]
        while len(at):
            on[at] = True
            at = back[at]
            at = at[back[at] >= 0]
        end = np.flatnonzero(on)
        piece, texts = last[end], np.searchsorted(stop, end)
        count, raw = np.ones(len(end), np.int64), np.flatnonzero(piece < 0)
        spelt = [chr(c).encode("utf-8", "replace") for c in codes[end[raw] - 1].tolist()]
        count[raw] = [len(x) for x in spelt]
        ids = np.repeat(piece, count).astype(np.uint32)
        if len(raw):
            ids[np.repeat(piece < 0, count)] = self.byte[np.frombuffer(b"".join(spelt), np.uint8)]
        return ids, np.bincount(texts, count, len(stop)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The normalised text in UTF-8, blanks as blanks, that the ids stand for, without the blank before it."""
        size = self.out_size[ids]
        reach = np.cumsum(size)
        out = self.out_bytes[np.repeat(self.out_first[ids] - (reach - size), size) + np.arange(reach[-1] if len(reach) else 0)].tobytes()
        return out[1:] if self.prefix and out[:1] == b" " else out


class PieceEncoder:
    """Encodes many texts; keeps the ids of the stretches met."""

    def __init__(self, path: str = MODEL, kept: int = KEPT):
        self.fst, self.store = Transducer(path), IdStore(kept)

    def normalised(self, text: bytes) -> bytes:
        """What decoding gives back."""
        return text.replace(_META, b" ") if _META in text else text

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text."""
        # the normaliser's first arc reads nothing and writes a blank
        before = b" " if self.fst.prefix else b""
        raw = b"".join((before + t if t else b"") + b"\xff" for t in texts)
        data = np.frombuffer(raw, np.uint8)
        blank, stop = data == 32, data == 0xFF
        at = raw.find(_META)
        while at >= 0:
            blank[at : at + len(_META)] = True
            at = raw.find(_META, at + len(_META))
        first = np.concatenate([[True], stop[:-1]]) | stop
        first[1:] |= blank[1:] & ~blank[:-1]
        start = np.flatnonzero(first)
        end = np.concatenate([start[1:], [len(data)]])
        stops = stop[start]
        if len(self.store) > self.store.most:
            self.store.clear()
        rows, before_ = np.flatnonzero(~stops & (end - start <= LONGEST)), len(self.store)
        number = np.full(len(start), -1, np.int32)
        number[rows], new = self.store.numbers(Stretches(data, start[rows], end[rows]))
        solve = lambda rows: self.fst.shortest([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[rows].tolist(), end[rows].tolist())])
        if len(new):
            ids, counts = solve(rows[new])
            self.store.put(np.arange(before_, len(self.store)), counts, ids)
        apart = np.flatnonzero(~stops & (end - start > LONGEST))
        ids, reach = self.store.lay_out(number, {i: solve(np.array([i]))[0] for i in apart.tolist()})
        cuts = [0, *reach[stops].tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


_OWN: dict[str, PieceEncoder] = {}


def piece_encoder(path: str = MODEL) -> PieceEncoder:
    """This worker's encoder."""
    if path not in _OWN:
        _OWN[path] = PieceEncoder(path)
    return _OWN[path]


_OUT = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
_OUT_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_pieces", "n_byte_pieces", "ids_crc32")] + [("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def encode_ids(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids (array<int>) of each whole text; null text counts as empty and has none."""
    let_workers_import(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(path)
        for batch in slices(batches, 1):
            yield record(schema, batch.column(0), [x.astype(np.int32) for x in own.encode(utf8(batch.column(1)))])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that ids (array<int>) stand for; null ids give null, ids out of the vocabulary an error."""
    let_workers_import(rows.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(path).fst
        for batch in batches:
            yield record(schema, batch.column(0), [None if x is None else own.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; a digest of both, a row a document.

    n_pieces, n_byte_pieces (ids of the byte fallback), ids_crc32 (of the ids
    as little-endian unsigned 32-bit), decoded_sha256 and round_trip (decoding
    gives the text again, but for U+2581, which means a blank). Null text
    counts as empty, without ids. Null ids pass through; repeated rows are
    encoded alike; other columns are not read; no rows give no rows.
    """
    let_workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(path)
        low, high = int(own.fst.byte.min()), int(own.fst.byte.max())
        for batch in slices(batches, 1):
            texts = utf8(batch.column(1))
            ids = own.encode(texts)
            back = [own.fst.decode(x.astype(np.int64)) for x in ids]
            yield record(
                _OUT_ARROW, batch.column(0), [len(x) for x in ids], [int(((x >= low) & (x <= high)).sum()) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], [hashlib.sha256(x).hexdigest() for x in back],
                [x == own.normalised(t) for x, t in zip(back, texts)],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _OUT)
