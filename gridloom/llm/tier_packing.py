"""Hierarchical packing of token sequences for several context sizes.

Contexts come in tiers, WINDOW tokens and its halves down to the smallest. A
document's whole windows become sequences of the largest tier. What remains of
it is routed to the smallest tier that holds it. Tiers are packed from the
largest down: a window opens with a remainder of its tier, and its gap is
filled from the shorter tiers, each time by the longest that fits; only when
none fits is one cut, its rest routed anew. So windows end full, and as every
window is a power of two long, full windows have no padding.

Sequences of a tier are dealt to step groups of STEP_TOKENS tokens, so that
every optimiser step of a tier sees as many tokens in windows of one size.

Packing is done where the documents are read, in pools of bounded size; no row
moves. A partition ends with at most one sequence that is padded.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import record, slices, utf8
from gridloom.llm.tokens import BYTE_BPE, encoder
from gridloom.session import let_workers_import

WINDOW = 1024
SMALLEST = 64
END_ID = 0
#: Tokens in a step group.
STEP_TOKENS = 8 * WINDOW
#: Remainders that are packed together.
POOL = 4096

_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
_OUT = ", ".join(f"{x} long" for x in _NAMES)
_OUT_ARROW = pa.schema([(x, pa.int64()) for x in _NAMES])


class Packer:
    """Packs documents as they come; take() gives the pieces that are placed so far."""

    def __init__(self, first_id: int, window: int = WINDOW, smallest: int = SMALLEST, step_tokens: int = STEP_TOKENS, pool: int = POOL):
        self.window, self.smallest, self.step_tokens, self.pool_size = window, smallest, step_tokens, pool
        self.next_sequence = self.next_group = first_id
        self.rows: list[tuple] = []
        self.open_groups: dict[int, list[int]] = {}
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.lengths, self.pooled = 0, 0

    def _group(self, tier: int) -> int:
        group = self.open_groups.get(tier)
        if group is None or group[1] + tier > self.step_tokens:
            group = self.open_groups[tier] = [self.next_group, 0]
            self.next_group += 1
        group[1] += tier
        return group[0]

    def _place(self, pieces: list[tuple], tier: int) -> None:
        sequence, group, offset = self.next_sequence, self._group(tier), 0
        self.next_sequence += 1
        for doc_id, total, start, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, sequence, offset, tier, group))
            offset += n

    def _put(self, piece: tuple) -> None:
        n = len(piece[3]) // 4
        self.pool[n].append(piece)
        self.lengths |= 1 << n
        self.pooled += 1

    def _pop(self, most: int) -> tuple | None:
        """The longest remainder of at most that many tokens."""
        n = (self.lengths & ((2 << most) - 1)).bit_length() - 1
        if n <= 0:
            return None
        own = self.pool[n]
        piece = own.pop()
        self.pooled -= 1
        if not own:
            self.lengths ^= 1 << n
        return piece

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, view, size = len(ids) // 4, memoryview(ids), 4 * self.window
        whole = len(ids) // size
        for i in range(whole):
            self._place([(doc_id, total, i * self.window, view[i * size : (i + 1) * size])], self.window)
        if len(ids) > whole * size:
            self._put((doc_id, total, whole * self.window, ids[whole * size :]))
        if self.pooled >= self.pool_size:
            self.pack()

    def _fill(self, tier: int) -> bool:
        """Pack one window of a tier from what the pool holds; False if it can't be filled."""
        first = self._pop(tier)
        pieces, gap = [first], tier - len(first[3]) // 4
        while gap:
            piece = self._pop(gap)
            if piece is None and self.lengths:
                shortest = (self.lengths & -self.lengths).bit_length() - 1
                doc_id, total, start, ids = self._pop(shortest)
                piece = (doc_id, total, start, ids[: 4 * gap])
                self._put((doc_id, total, start + gap, ids[4 * gap :]))
            if piece is None:
                for piece in pieces:
                    self._put(piece)
                return False
            pieces.append(piece)
            gap -= len(piece[3]) // 4
        self._place(pieces, tier)
        return True

    def pack(self, last: bool = False) -> None:
        tier, full = self.window, True
        while full and tier >= self.smallest:
            while full and self.lengths >> (tier // 2 if tier > self.smallest else 0) > 1:
                full = self._fill(tier)
            tier //= 2
        # What is left fills no window of its tier: whole windows of smaller tiers are taken from it.
        left: list[tuple] = []
        while (piece := self._pop(self.window)) is not None:
            left.append(piece)
        tier, size = self.window, sum(len(p[3]) for p in left) // 4
        while tier >= self.smallest:
            if size >= tier:
                taken, left = _split(left, tier)
                self._place(taken, tier)
                size -= tier
            else:
                tier //= 2
        if last and left:
            self._place(left, self.window)
        elif left:
            for piece in left:
                self._put(piece)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _split(pieces: list[tuple], tokens: int) -> tuple[list[tuple], list[tuple]]:
    """The first tokens of pieces, and the rest."""
    taken, rest = [], []
    for doc_id, total, start, ids in pieces:
        n = min(tokens, len(ids) // 4)
        if n:
            taken.append((doc_id, total, start, ids[: 4 * n]))
        if 4 * n < len(ids):
            rest.append((doc_id, total, start + n, ids[4 * n :]))
        tokens -= n
    return taken, rest


def pack_documents(docs: DataFrame, path: str = BYTE_BPE, end_id: int = END_ID, window: int = WINDOW, smallest: int = SMALLEST, step_tokens: int = STEP_TOKENS, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the ids of all texts into sequences of at most window tokens, a row a piece.

    A document is its text's ids by the tokenizers library, without special
    tokens, and then end_id. Columns: doc_id, start (its ids before the piece),
    length, ids_crc32 (of the piece, as little-endian unsigned 32-bit), the
    document's doc_tokens, sequence_id, offset in the sequence, tier (the
    padded length) and step_group. Each id is in exactly one piece. Null text
    counts as empty: only the end id. Null ids are returned as null, repeated
    rows are packed each, texts of any length are packed whole; other columns
    are not read; no rows give no rows. Of remainders of one length the one that
    came last is taken first, so which sequence a piece is in depends on the
    order and partitioning of the rows; that each id is in one does not.
    """
    let_workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 40, window, smallest, step_tokens, pool)
        for batch in slices(batches, 1):
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(utf8(batch.column(1)))):
                packer.add(doc_id, ids + end)
            if rows := packer.take():
                yield record(_OUT_ARROW, *zip(*rows))
        packer.pack(last=True)
        if rows := packer.take():
            yield record(_OUT_ARROW, *zip(*rows))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _OUT)
