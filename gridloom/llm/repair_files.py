"""Token-id files compressed by a Re-Pair grammar, for random access.

Documents are encoded where they are read, dealt to ranges of ascending id and
cut into shards of whole documents. Within a shard, adjacent id pairs that lie
within a document are replaced by nonterminals, the most frequent first, until
no pair occurs LEAST times without overlap, whatever the size of the shard. A
round counts all pairs by sorting and replaces each where it is more frequent
than the pairs that it overlaps with, so that the most frequent pair of all goes
whole in any round. A pair that is too rare stays so, as only pairs with a new
nonterminal can be new; so later rounds sort few.

A shard is one row of a Parquet table: the rules, the length that each
nonterminal expands to, the reduced sequence, both in planes of bytes, and for
each document its id, its place in the sequence and its number of ids. One document, or one id of it, is
decoded without the rest (decode, id_at).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import record, slices, utf8
from gridloom.llm.tokens import BYTE_BPE, encoder
from gridloom.session import let_workers_import, written

END_ID = 2
#: Ids that a shard has at least, but for the last of a range.
SHARD_IDS = 1 << 20
#: Occurrences of a pair that is replaced.
LEAST = 2
#: Stands for a null id where ids are put in order.
_NO_ID = -(1 << 63)

_CODED = "bucket int, doc_id long, crc long, ids binary"
_CODED_ARROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])
_SHARD = "bucket int, shard int, start long, ids long, first_new long, width int, rules binary, lengths binary, levels array<int>, sequence binary, doc_ids array<long>, places binary, sizes binary"
_SHARD_ARROW = pa.schema(
    [("bucket", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("ids", pa.int64()), ("first_new", pa.int64()), ("width", pa.int32()), *((x, pa.binary()) for x in ("rules", "lengths")), ("levels", pa.list_(pa.int32())), ("sequence", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("places", pa.binary()), ("sizes", pa.binary())]
)
_OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"
_OUT_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])


@dataclass
class Grammar:
    """rules: pairs of symbols; nonterminal first_new + i expands to rule i, lengths[i] ids; levels: rules after each round."""

    first_new: int
    rules: np.ndarray
    lengths: np.ndarray
    levels: list[int]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of a sequence of symbols."""
        symbols, size = symbols.astype("<u4"), self.length(symbols)
        at, out = np.cumsum(size) - size, np.empty(int(size.sum()), "<u4")
        while len(symbols):
            new = symbols >= self.first_new
            plain, new = np.flatnonzero(~new), np.flatnonzero(new)
            out[at[plain]] = symbols[plain]
            pairs, at = self.rules[symbols[new].astype(np.int64) - self.first_new], at[new]
            symbols = np.concatenate([pairs[:, 0], pairs[:, 1]])
            at = np.concatenate([at, at + self.length(pairs[:, 0])])
        return out

    def length(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol expands to."""
        out = np.ones(len(symbols), np.int64)
        new = np.flatnonzero(symbols >= self.first_new)
        out[new] = self.lengths[symbols[new].astype(np.int64) - self.first_new]
        return out


def _mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit values that spreads every bit (finaliser of a 32-bit hash)."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _in_order(left: np.ndarray, right: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of symbols below top in ascending order, as left << 32 | right, and where they were."""
    bits, places = np.uint64(int(top).bit_length()), np.uint64(len(left).bit_length())
    if 2 * bits + places > 64:
        key = (left.astype(np.uint64) << np.uint64(32)) | right
        order = np.argsort(key, kind="stable")
        return key[order], order
    # with its place each pair fits in one value, and sorting values is several times as fast as sorting places
    key = (((left.astype(np.uint64) << bits) | right) << places) | np.arange(len(left), dtype=np.uint64)
    key.sort()
    pair = key >> places
    low = (np.uint64(1) << bits) - np.uint64(1)
    return ((pair >> bits) << np.uint64(32)) | (pair & low), (key & ((np.uint64(1) << places) - np.uint64(1))).view(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, first_new: int, rounds: int | None = None, frequent: int | None = None) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Grammar, reduced sequence and the documents' ends in it; ends: the documents' ends in ids.

    rounds and frequent, where given, stop early: after so many rounds, and at
    pairs that are fewer than one in so many ids.
    """
    least = LEAST if frequent is None else max(LEAST, -(-len(ids) // frequent))
    rules, lengths, levels = np.zeros((0, 2), np.uint32), np.zeros(0, np.int64), []
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)  # of a document
    last[ends[ends > 0] - 1] = True
    open_ = ~last  # symbols that may begin a pair to replace
    while rounds is None or len(levels) < rounds:
        at = np.flatnonzero(open_)
        if not len(at):
            break
        left, right = symbols[at], symbols[at + 1]
        ordered, order = _in_order(left, right, first_new + len(rules))
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        pair = np.empty(len(at), np.int32)
        pair[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        pairs = ordered[new]
        apart = np.concatenate([[True], np.diff(at) > 1])
        same = np.flatnonzero(left == right)
        start = np.concatenate([[True], np.diff(same) > 1])[: len(same)] | apart[same]
        second = same[(np.arange(len(same)) - np.maximum.accumulate(np.where(start, np.arange(len(same)), 0))) % 2 == 1]  # of runs of overlapping pairs, every second doesn't count
        counts = np.bincount(pair, minlength=len(pairs)) - np.bincount(pair[second], minlength=len(pairs))
        # pairs by frequency, no two alike; equally frequent ones in an order that has no long descents along the text
        rank = np.where(counts >= least, (counts.astype(np.uint64) << np.uint64(32)) | _mix32(np.arange(len(pairs), dtype=np.uint32)), np.uint64(0))
        own = rank[pair]
        open_[at[np.flatnonzero(own == 0)]] = False
        own[second] = 0
        first = own > 0
        first[1:] &= apart[1:] | (own[:-1] < own[1:])
        first[:-1] &= apart[1:] | (own[1:] < own[:-1])
        first = np.flatnonzero(first)
        pair = pair[first]
        chosen = np.bincount(pair, minlength=len(pairs)) >= least
        if not chosen.any():
            break
        used = np.flatnonzero(chosen[pair])
        at, named = at[first[used]], (np.cumsum(chosen, dtype=np.int32) - np.int32(1))[pair[used]]
        added = np.stack([pairs[chosen] >> np.uint64(32), pairs[chosen] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        grammar = Grammar(first_new, rules, lengths, levels)
        sizes = grammar.length(added[:, 0]) + grammar.length(added[:, 1])
        symbols[at] = first_new + len(rules) + named
        last[at] = last[at + 1]
        open_[at] = ~last[at]
        before = at[at > 0] - 1
        open_[before] = ~last[before]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        ends = ends - np.searchsorted(at + 1, ends)
        symbols, last, open_ = symbols[keep], last[keep], open_[keep]
        rules, lengths = np.concatenate([rules, added]), np.concatenate([lengths, sizes])
        levels = [*levels, len(rules)]
    return Grammar(first_new, rules, lengths, levels), symbols, ends


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest width bytes of each value; all lowest bytes first, then all second ones and so on, which compresses better."""
    return values.astype("<u4").reshape(-1).view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def _values(planes: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u4")[:, 0]


def _shard_row(bucket: int, shard: int, start: int, docs: list[tuple[int | None, np.ndarray]], first_new: int) -> tuple:
    sizes = np.array([len(x) for _, x in docs], np.int64)
    grammar, symbols, places = compress(np.concatenate([x for _, x in docs]), np.cumsum(sizes), first_new)
    width = max(1, -(-int(first_new + len(grammar.rules) - 1).bit_length() // 8))
    return (
        bucket, shard, start, int(sizes.sum()), first_new, width, _planes(grammar.rules.T, width), grammar.lengths.astype("<u4").tobytes(), grammar.levels, _planes(symbols, width), [d for d, _ in docs],
        np.concatenate([[0], places]).astype("<u4").tobytes(), sizes.astype("<u4").tobytes(),
    )


class Shard:
    """A shard as read back."""

    def __init__(self, row: dict):
        self.grammar = Grammar(row["first_new"], np.ascontiguousarray(_values(row["rules"], row["width"]).reshape(2, -1).T), np.frombuffer(row["lengths"], "<u4").astype(np.int64), row["levels"])
        self.symbols = _values(row["sequence"], row["width"])
        self.places, self.sizes, self.doc_ids = np.frombuffer(row["places"], "<u4").astype(np.int64), np.frombuffer(row["sizes"], "<u4").astype(np.int64), row["doc_ids"]

    def decode(self, k: int) -> np.ndarray:
        """Ids of document number k of the shard."""
        return self.grammar.expand(self.symbols[self.places[k] : self.places[k + 1]])

    def id_at(self, k: int, i: int) -> int:
        """Id number i of document number k, by the expansion lengths alone."""
        if not 0 <= i < self.sizes[k]:
            raise IndexError(i)
        own = self.symbols[self.places[k] : self.places[k + 1]]
        reach = np.cumsum(self.grammar.length(own))
        at = int(np.searchsorted(reach, i, side="right"))
        symbol, i = int(own[at]), i - (int(reach[at - 1]) if at else 0)
        while symbol >= self.grammar.first_new:
            left, right = map(int, self.grammar.rules[symbol - self.grammar.first_new])
            size = int(self.grammar.length(np.array([left]))[0])
            symbol, i = (left, i) if i < size else (right, i - size)
        return symbol


def buckets_of(cuts: np.ndarray, ids: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Bucket of each row by its place among the sorted cuts; an id that several cuts have is split by its rows' checksums."""
    left, right = np.searchsorted(cuts, ids, side="left"), np.searchsorted(cuts, ids, side="right")
    split = right - left > 1
    return np.where(split, left + 1 + ((crc * (right - left)) >> 32), right)


def write_files(docs: DataFrame, path: str = BYTE_BPE, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> DataFrame:
    """Encode all texts and write the shards to the folder out, without one to the shared folder; the table read back."""
    spark = docs.sparkSession
    let_workers_import(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = F.coalesce("doc_id", F.lit(_NO_ID).cast("long"))
    cuts = np.array(rows.select(F.percentile_approx(number, [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.array([end_id], "<u4")
        kind = "<u2" if max(own.size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in slices(batches, 1):
            ids = [np.concatenate([np.frombuffer(x, "<u4"), end]).astype(kind).tobytes() for x in own.encode(utf8(batch.column(1)))]
            crc = np.array([zlib.crc32(x) for x in ids], np.int64)
            at = buckets_of(cuts, batch.column(0).fill_null(_NO_ID).to_numpy(), crc)
            yield record(_CODED_ARROW, at.astype(np.int32), batch.column(0), crc, ids)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(encoder(path).size, end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        bucket, shard, start, have, held = None, 0, 0, 0, []

        def close() -> pa.RecordBatch:
            return record(_SHARD_ARROW, *([x] for x in _shard_row(bucket, shard, start, held, size)))

        for batch in batches:
            for b, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if held and (b != bucket or have >= shard_ids):
                    yield close()
                    shard, start, have, held = shard + 1, start + have, 0, []
                if b != bucket:
                    bucket, shard, start = b, 0, 0
                x = np.frombuffer(ids, kind)
                held.append((doc_id, x))
                have += len(x)
        if held:
            yield close()

    coded = rows.mapInArrow(encode, _CODED).repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "crc", "ids")
    found = coded.mapInArrow(shards, _SHARD)
    if out is None:
        return written(found, "repair-shards")[0]
    found.write.option("compression", "zstd").parquet(out)
    return open_files(spark, out)


def open_files(spark: SparkSession, folder: str) -> DataFrame:
    """The shards that write_files wrote to a folder."""
    return spark.read.schema(_SHARD).parquet(folder)


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    let_workers_import(shards.sparkSession)
    total = {r["bucket"]: r["n"] for r in shards.groupBy("bucket").agg(F.sum("ids").alias("n")).collect()}
    base, before = {}, 0
    for bucket in sorted(total):
        base[bucket], before = before, before + total[bucket]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                ids, ends = memoryview(shard.grammar.expand(shard.symbols).tobytes()), np.cumsum(shard.sizes).tolist()
                begins = [0, *ends[:-1]]
                at = base[row["bucket"]] + row["start"]
                yield record(_OUT_ARROW, row["doc_ids"], [at + a for a in begins], shard.sizes, [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins, ends)])

    return shards.mapInArrow(run, _OUT)


def encode_to_files(docs: DataFrame, path: str = BYTE_BPE, end_id: int = END_ID, shard_ids: int = SHARD_IDS, out: str | None = None) -> DataFrame:
    """Write the id files of all texts and read them back: doc_id, start, n_tokens, ids_crc32.

    Each text's ids, by the tokenizers library without special tokens, and then
    end_id, in the order of ascending doc_id; start counts the ids of all
    documents before. Null text counts as empty: only the end id. Null ids come
    first; rows with equal ids come in the order of the checksum of their ids,
    by which very many of them are dealt to several files; repeated rows each
    have their place. Other columns are not read. No rows give none. out: the
    folder that keeps the files, which must not exist.
    """
    return read_documents(write_files(docs, path, end_id, shard_ids, out=out))
