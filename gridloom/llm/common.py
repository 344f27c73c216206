"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that an operator handles at once; a longer text makes a slice of its own.
SLICE_BYTES = 1_000_000
#: The bytes of [\x20\x09-\x0D].
BLANKS = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that column number text has about limit bytes in each part."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes.astype(np.int64)) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of a 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores appended until df has no such column, whatever the case of its letters."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


#: Values of the hash by which rows are pre-selected in a broadcast: bounds its size.
PRESELECT = 1 << 20


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have an id of ids, rows that surely have none); null counts as an id.

    Rows are selected by a hash of the id in a broadcast of at most PRESELECT
    values, so that most need no shuffle where ids are few. Where ids are very
    many all rows may have one, and nothing is lost but the saving.
    """
    number = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(PRESELECT)).cast("int")
    mine, theirs = unused(docs, "_own_number", "_number")
    some = ids.select(number(F.col(ids.columns[0])).alias(theirs)).distinct()
    own = docs.withColumn(mine, number(F.col(id_col)))
    join = lambda how: own.join(F.broadcast(some), F.col(mine) == F.col(theirs), how).drop(mine)
    return join("left_semi"), join("left_anti")


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id isn't in the only column of ids; docs' columns as they are."""
    (name,) = unused(docs, "_gone")
    gone = ids.select(F.col(ids.columns[0]).cast("long").alias(name)).distinct()
    maybe, surely = split_by_ids(docs, gone, id_col)
    kept = maybe.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_anti")
    return surely.unionByName(kept)


#: Groups of read partitions in which the first rows of a key are sought before they meet.
SALTS = 1024


def first_of_each(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each value of key, by order; of equals any.

    Sought first in every partition, then in SALTS groups of partitions, then
    among what those give, at most n rows of each: no task takes a whole group,
    also where very many rows are equal.
    """
    salt, place = unused(df, "_salt", "_place")
    found = df.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for parts in ([key, salt], [key]):
        number = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
        found = found.withColumn(place, number).where(F.col(place) <= n).drop(place)
    return found.drop(salt)


#: Bytes of a stretch that is compared as it is; a longer one is by its BLAKE2b digest.
WIDE = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Stretches:
    """Stretches data[start:end] of bytes, with hashes and exact comparison, eight bytes at a time.

    A stretch of more than WIDE bytes stands for itself by its length and a
    digest of 32 bytes, so that no structure in its bytes makes hashes equal.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.size = (end - start).astype(np.int64)
        self.start = self.at = start.astype(np.int64)
        self.n = self.size
        long = np.flatnonzero(self.size > WIDE)
        digests = b"".join(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=32).digest() for i in long.tolist())
        self.data = np.concatenate([data, np.frombuffer(digests, np.uint8), np.zeros(8, np.uint8)])
        if len(long):
            self.at, self.n = self.at.copy(), self.n.copy()
            self.at[long], self.n[long] = len(data) + 32 * np.arange(len(long)), 32
        self.names = self._names()

    def part(self, rows: np.ndarray | slice, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 8 of stretches that are longer than 8k, as numbers."""
        eights = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        return eights[self.at[rows] + 8 * k] & _MASKS[np.minimum(self.n[rows] - 8 * k, 8)]

    def _names(self) -> np.ndarray:
        """64-bit hashes, never 0; equal stretches have equal hashes."""
        out = self.size.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
        full = self.n > 0
        self.head = np.where(full, self.part(slice(None), 0), np.uint64(0)) if len(out) else np.zeros(0, np.uint64)
        out = np.where(full, mix64(out * np.uint64(0x9E3779B97F4A7C15) ^ self.head), out)
        rows, k = np.flatnonzero(self.n > 8), 1
        while len(rows):
            out[rows] = mix64(out[rows] * np.uint64(0x9E3779B97F4A7C15) ^ self.part(rows, k))
            k += 1
            rows = rows[self.n[rows] > 8 * k]
        out[out == 0] = 1
        return out

    def take(self, rows: np.ndarray) -> Stretches:
        """Some of the stretches; the bytes are shared."""
        out = object.__new__(Stretches)
        out.data, out.size, out.start, out.at, out.n, out.names, out.head = self.data, self.size[rows], self.start[rows], self.at[rows], self.n[rows], self.names[rows], self.head[rows]
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """What stands for the stretches, one after the other, and where each begins."""
        first = np.cumsum(self.n) - self.n
        return self.data[np.repeat(self.at - first, self.n) + np.arange(int(self.n.sum()))], first

    def same(self, rows: np.ndarray, other: Stretches, at: np.ndarray) -> np.ndarray:
        """Whether stretch rows[i] is other's stretch at[i], for each i."""
        out = (self.size[rows] == other.size[at]) & (self.head[rows] == other.head[at])
        left, k = np.flatnonzero(out & (self.n[rows] > 8)), 1
        while len(left):
            out[left] = equal = self.part(rows[left], k) == other.part(at[left], k)
            k += 1
            left = left[equal]
            left = left[self.n[rows[left]] > 8 * k]
        return out


class WordStore:
    """A hash table from words, given as stretches, to their numbers; every hit is compared by bytes."""

    def __init__(self, most: int):
        self.bits, self.most = 16, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.words = Stretches(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def __len__(self) -> int:
        return len(self.words.names)

    def find(self, words: Stretches) -> np.ndarray:
        """Number of each word, -1 if it is unknown."""
        names, mask = words.names, np.uint64(len(self.keys) - 1)
        slot, out = (names & mask).astype(np.int64), np.full(len(names), -1, np.int32)
        go = np.arange(len(names))
        while len(go):
            key = self.keys[slot[go]]
            hit = np.flatnonzero(key == names[go])
            rows, at = go[hit], self.slots[slot[go[hit]]]
            right = words.same(rows, self.words, at)
            out[rows[right]] = at[right]
            key[hit[right]] = 0
            go = go[key != 0]
            if len(go):
                slot[go] = (slot[go] + 1) & int(mask)
        return out

    def _insert(self, names: np.ndarray, numbers: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = (names & mask).astype(np.int64)
        left = np.arange(len(names))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.slots[slot[won]] = names[won], numbers[won]
            done = np.zeros(len(names), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & int(mask)

    def add(self, words: Stretches) -> None:
        """New words, each once."""
        old, mine, (own, first) = len(self), self.words, words.packed()
        size = len(mine.data) - 8
        mine.data = np.concatenate([mine.data[:size], own, np.zeros(8, np.uint8)])
        kind = np.int32 if len(mine.data) < 1 << 31 else np.int64
        mine.at, mine.size = np.concatenate([mine.at, first + size]).astype(kind), np.concatenate([mine.size, words.size]).astype(kind)
        mine.n = np.where(mine.size > WIDE, 32, mine.size).astype(np.int8)
        mine.names, mine.head = np.concatenate([mine.names, words.names]), np.concatenate([mine.head, words.head])
        names = words.names
        if 2 * len(self) > len(self.keys):
            while 2 * len(self) > 1 << self.bits:
                self.bits += 1
            self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            old, names = 0, mine.names
        self._insert(names, np.arange(old, len(self), dtype=np.int32))

    def numbers(self, words: Stretches) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, and for each word that is new, in the order of its number, a place where it stands.

        Two new words of one hash are added one after the other.
        """
        number, places = self.find(words), []
        while len(unknown := np.flatnonzero(number < 0)):
            _, first = np.unique(words.names[unknown], return_index=True)
            new = unknown[first]
            self.add(words.take(new))
            places.append(new)
            number[unknown] = self.find(words.take(unknown))
        return number, np.concatenate(places) if places else np.zeros(0, np.int64)
