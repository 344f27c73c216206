"""Near-duplicates by MinHash with tensored banding, confirmed on full sets.

A document is the set of its distinct word shingles. Documents with the same
words in the same order (by a digest of 32 bytes) form a class; the rest works
on one row a class. Classes with the same set are linked like others. MinHash
values are made for two small collections only, each of TABLES bands of ROWS
values. A hash table's key is the combination of one band of the first
collection with one of the second, which gives TABLES * TABLES tables of
2 * ROWS values each from 2 * TABLES * ROWS values in all, about the square root
of what separate tables would need. A pair of similarity s meets with
probability (1 - (1 - s^ROWS)^TABLES)^2, which is 0.99998 at 0.8.

Rows are dealt by their band of the first collection; the tables of the second
are made where they arrive. Bands that very many share are split by a salt, and
all their members are set aside, also those that are alone in their part.
Tables' buckets of at most SMALL members give all their pairs; larger ones give
links to one leader, and their members are set aside. Candidates of too unequal
size, or of clearly lower similarity by their whole signatures, are dropped, and
the others are confirmed on the full sets of shingles of their texts. After
components are found, those set aside in a band whose members lie in several
components are taken up again: they are joined by their rarest shingles, which
finds every pair that is similar enough (prefix filter), so that no link is lost
that a leader didn't show. A member is set aside once a band, in a row for all of
the band's tables: at most TABLES rows, however large a group it is in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Stretches, mix64, record, slices, split_by_ids, utf8, without
from gridloom.session import drop, let_workers_import, written

TABLES = 16
ROWS = 3
#: Similarity of linked documents, in hundredths.
PERCENT = 80
#: A candidate whose signatures agree in a smaller share is dropped: five standard deviations below 0.8.
LEAST_AGREEMENT = 0.6
#: Members of a bucket that gives all its pairs.
SMALL = 8
#: Members of a band that one task takes.
HOT = 20_000

_VALUES = 2 * TABLES * ROWS
_SEED = np.random.default_rng(20170612)
_MUL = (_SEED.integers(1, 1 << 31, _VALUES, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_ADD = _SEED.integers(0, 1 << 32, _VALUES, dtype=np.uint32)
_MUL2 = (_SEED.integers(1, 1 << 31, _VALUES, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True

_SIGNED = "doc_id long, n long, digest binary, a array<int>, b binary, low binary"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("a", pa.list_(pa.int32())), ("b", pa.binary()), ("low", pa.binary())])


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at [\\x20\\x09-\\x0D]."""
    return text.lower().split()


def shingle_set(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """Distinct shingles; with fewer words the whole sequence as one; without words none."""
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(width))))


def word_stretches(texts: list[bytes]) -> tuple[Stretches, np.ndarray]:
    """All words of lower-cased texts, and each text's number of words."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    starts_of = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    return Stretches(data, start, end), np.diff(np.searchsorted(start, starts_of))


def shingle_hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words_, counts = word_stretches(texts)
    hashes, out, at = words_.names, [], 0
    with np.errstate(over="ignore"):
        for n in counts.tolist():
            own = hashes[at : at + n]
            at += n
            k = min(n, width)
            if not k:
                out.append(own)
                continue
            total = own[: n - k + 1] + np.uint64(k)
            for i in range(1, k):
                total = mix64(total * np.uint64(0xD6E8FEB86659FD93) + own[i : n - k + 1 + i])
            out.append(np.unique(total))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets x values) of sets of which none is empty."""
    sizes = [len(s) for s in sets]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), _VALUES), np.uint32)
    for k in range(_VALUES):
        v = x * _MUL[k] + _ADD[k]
        v ^= v >> np.uint32(15)
        v *= _MUL2[k]
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """32-bit keys of the 2 * TABLES bands."""
    v = values.reshape(len(values), 2 * TABLES, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = v[:, :, 0]
        for i in range(1, ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + v[:, :, i])
        return (mix64(key + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = utf8(batch.column(1))
            sets = shingle_hashes(texts, width)
            a, b, low = [[] for _ in sets], [b""] * len(sets), [b""] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                values = minhashes([sets[i] for i in full])
                keys = bands(values)
                first, second, small = keys[:, :TABLES].view(np.int32).tolist(), keys[:, TABLES:], values.astype(np.uint8)
                for at, i in enumerate(full):
                    a[i], b[i], low[i] = first[at], second[at].tobytes(), small[at].tobytes()
            yield record(_SIGNED_ARROW, batch.column(0), [len(s) for s in sets], [hashlib.blake2b(b" ".join(words(t)), digest_size=32).digest() for t in texts], a, b, low)

    return run


_FOUND = "bucket long, one long, two long"
_FOUND_ARROW = pa.schema([("bucket", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])


def _bucket_pairs(group: np.ndarray, salted: np.ndarray, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, percent: int, whole: np.ndarray) -> tuple[list, list]:
    """Candidates (least id first), and (bucket, id) of the members of large buckets and of all in salted bands.

    group: number of the band's value, whole: the same as a hash without salt,
    salted: the value is split over several tasks. Members set aside are named
    by whole, not by their table's key, so that tables of one band repeat them.
    """
    n = len(ids)
    least = (sizes * percent + 99) // 100
    orders, popularity, pairs, aside = [], np.zeros(n, np.int64), [], []

    def set_aside(rows: np.ndarray) -> None:
        aside.append((whole[rows].view(np.int64), ids[rows]))

    split = np.flatnonzero(salted)
    for j in range(TABLES):
        key = (group.astype(np.uint64) << np.uint64(32)) | keys[:, j]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.concatenate([start, [n]]))
        members = np.repeat(count, count)
        popularity[order] += members - 1
        large = members > 1
        orders.append(order[large])
        set_aside(split)
    rank = np.floor(4 * np.log2(popularity + 1.0)).astype(np.int64)
    for j in range(TABLES):
        rows = orders[j]
        if not len(rows):
            continue
        key = (group[rows].astype(np.uint64) << np.uint64(32)) | keys[rows, j]
        order = np.lexsort((ids[rows], -rank[rows], key))
        rows, key = rows[order], key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([start, [len(rows)]]))
        members = np.repeat(count, count)
        place = np.arange(len(rows)) - np.repeat(start, count)
        for back in range(1, SMALL):
            at = np.flatnonzero((members <= SMALL) & (place >= back))
            pairs.append((rows[at - back], rows[at]))
        at = np.flatnonzero((members > SMALL) & (place > 0))
        pairs.append((rows[at - place[at]], rows[at]))
        set_aside(rows[(members > SMALL) & ~salted[rows]])
    out = []
    for x, y in pairs:
        ok = (sizes[x] >= least[y]) & (sizes[y] >= least[x]) & (ids[x] != ids[y])
        x, y = x[ok], y[ok]
        out.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])))
    return out, aside


def _collide(percent: int):
    """Candidates of rows that come in the order of (band value, salt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            band, salt, ids, sizes, keys = (np.concatenate(x) for x in zip(*parts))
            new = np.concatenate([[True], (band[1:] != band[:-1]) | (salt[1:] != salt[:-1])])
            group = np.cumsum(new) - 1
            pairs, aside = _bucket_pairs(group, salt >= 0, ids, sizes, keys, percent, band.view(np.uint64))
            one, two = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, np.int64), np.concatenate([y for _, y in pairs]) if pairs else np.zeros(0, np.int64)
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            keep = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, bool)
            one, two = one[keep], two[keep]
            for at in range(0, len(one), 50_000):
                part = slice(at, at + 50_000)
                yield record(_FOUND_ARROW, pa.nulls(len(one[part]), pa.int64()), one[part], two[part])
            # a member once a band, in however many tables its buckets were large
            name, ids_ = (np.concatenate(x) for x in zip(*aside))
            order = np.lexsort((ids_, name))
            name, ids_ = name[order], ids_[order]
            keep = np.concatenate([[True], (name[1:] != name[:-1]) | (ids_[1:] != ids_[:-1])]) if len(name) else np.zeros(0, bool)
            name, ids_ = name[keep], ids_[keep]
            for at in range(0, len(name), 50_000):
                part = slice(at, at + 50_000)
                yield record(_FOUND_ARROW, name[part], ids_[part], pa.nulls(len(name[part]), pa.int64()))

        have = 0
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            band, salt, ids, sizes = (batch.column(i).to_numpy() for i in range(4))
            keys = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(m, TABLES)
            new = np.flatnonzero((band[1:] != band[:-1]) | (salt[1:] != salt[:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            if not cut and held and (held[-1][0][-1] != band[0] or held[-1][1][-1] != salt[0]):
                if have > 50_000:
                    yield from flush(held)
                    held, have = [], 0
            elif cut:
                held.append((band[:cut], salt[:cut], ids[:cut], sizes[:cut], keys[:cut]))
                if have + cut > 50_000:
                    yield from flush(held)
                    held, have = [], -cut
                have += cut
            held.append((band[cut:], salt[cut:], ids[cut:], sizes[cut:], keys[cut:]))
            have += m - cut
        if held:
            yield from flush(held)

    return run


def _agree(least: float):
    """Keeps pairs whose whole signatures agree well enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("one", pa.int64()), ("two", pa.int64())])
        for batch in batches:
            m = batch.num_rows
            if m:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(m, _VALUES) for i in (2, 3))
                keep = (x == y).mean(axis=1) >= least
                yield record(schema, *(batch.column(i).to_numpy()[keep] for i in (0, 1)))

    return run


def _confirm(percent: int, width: int):
    """Links among pairs that come with both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("one", pa.int64()), ("two", pa.int64())])
        last, own = None, set()
        for batch in batches:
            one, two = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i, (a, b) in enumerate(zip(one, two)):
                if a != last:
                    last, own = a, shingle_set(batch.column(2)[i].as_py().encode("utf-8", "surrogatepass"), width)
                other = shingle_set(batch.column(3)[i].as_py().encode("utf-8", "surrogatepass"), width)
                both = len(own & other)
                if both and 100 * both >= percent * (len(own) + len(other) - both):
                    out.append((a, b))
            if out:
                yield record(schema, *zip(*out))

    return run


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, some at a time, as stars: each node with the smallest it reaches there."""
    schema = pa.schema([("one", pa.int64()), ("two", pa.int64())])
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int, root=root) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        yield record(schema, nodes, [find(x) for x in nodes])


def components(edges: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(node, component) for the nodes of edges(one, two): all but a component's smallest node.

    Rounds of stars: within partitions by union-find, then across them. Each
    node's smallest neighbour is aggregated before the shuffle, and edges meet
    it in a join that can be split, so that a node with very many neighbours is
    no bottleneck. Every round is a written table; it ends when the edges are
    stars: no node has two smaller ones, and none that has one is itself one.
    paths: gets the last table's path, which the result reads.
    """
    spark, before = edges.sparkSession, None
    edges = edges.select(F.greatest("one", "two").alias("one"), F.least("one", "two").alias("two")).where("one <> two")
    while True:
        edges = edges.mapInArrow(_local_roots, "one long, two long")
        low = edges.select(F.inline(F.array(F.struct(F.col("one").alias("node"), F.col("two").alias("m")), F.struct(F.col("two").alias("node"), F.col("two").alias("m")))))
        low = low.groupBy("node").agg(F.min("m").alias("m"))
        large = edges.join(low, F.col("two") == F.col("node")).select("one", F.col("m").alias("two"))
        least = large.groupBy(F.col("one").alias("node")).agg(F.min("two").alias("m"))
        small = large.join(least, F.col("one") == F.col("node")).select(F.inline(F.array(F.struct("one", F.col("m").alias("two")), F.struct(F.col("two").alias("one"), F.col("m").alias("two")))))
        edges, path = written(small.where("one <> two").distinct(), "stars")
        if before:
            drop(spark, before)
        before = path
        ends = edges.select(F.inline(F.array(F.struct(F.col("one").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("two").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        count = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if count.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            if paths is not None:
                paths.append(path)
            return edges.select(F.col("one").alias("node"), F.col("two").alias("component"))


class _Run:
    """One search for near-duplicates."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        let_workers_import(self.spark)
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.paths: list[str] = []  # of tables that the result reads
        self.signed = self.kept(self.texts.mapInArrow(_sign(width), _SIGNED), "minhash")
        one = self.signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "a", "b", "low")).alias("s"))
        self.classes = self.kept(one.select(F.col("s.doc_id").alias("id"), "s.n", "digest", "s.a", "s.b", "s.low"), "classes")

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, name)
        self.paths.append(path)
        return table

    def candidates(self) -> tuple[DataFrame, str]:
        """Pairs (one, two) of classes, and members (bucket, one) of the bands' values set aside; written."""
        # smaller sets reach the similarity only if they are equal. A band's salt is its own, so that the
        # members of a hot group meet other leaders in each band and their stars join
        fewest = -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1
        rows = self.classes.where(F.col("n") >= fewest).select("id", "n", "b", F.posexplode("a").alias("i", "a"))
        rows = rows.withColumn("band", F.shiftleft(F.col("i").cast("long"), 32) + F.col("a").cast("long").bitwiseAND(0xFFFFFFFF)).drop("i", "a")
        hot = rows.groupBy("band").count().where(F.col("count") > HOT).select("band", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
        rows = rows.join(hot, "band", "left").select(
            "band", F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id", "band"), F.col("parts")).cast("int")).alias("salt"), "id", "n", "b"
        )
        dealt = rows.repartition("band", "salt").sortWithinPartitions("band", "salt")
        return written(dealt.mapInArrow(_collide(self.percent), _FOUND), "collisions")

    def texts_of(self, ids: DataFrame) -> tuple[DataFrame, str]:
        """(doc_id, text) of the documents in ids; written."""
        texts = split_by_ids(self.texts.where("text is not null"), ids, "doc_id")[0]
        return written(texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    def links(self, pairs: DataFrame) -> tuple[DataFrame, str]:
        """Of candidate pairs (one, two) those that the full sets confirm; written."""
        low = self.classes.select("id", "low")
        met = pairs.join(low.withColumnsRenamed({"id": "one", "low": "low1"}), "one").join(low.withColumnsRenamed({"id": "two", "low": "low2"}), "two").select("one", "two", "low1", "low2")
        near, near_at = written(met.mapInArrow(_agree(LEAST_AGREEMENT), "one long, two long"), "near")
        texts, texts_at = self.texts_of(near.select(F.explode(F.array("one", "two")).alias("doc_id")).distinct())
        both = near.join(texts.withColumnsRenamed({"doc_id": "two", "text": "text2"}), "two").join(texts.withColumnsRenamed({"doc_id": "one", "text": "text1"}), "one").select("one", "two", "text1", "text2")
        found = written(both.mapInArrow(_confirm(self.percent, self.width), "one long, two long"), "links")
        drop(self.spark, near_at, texts_at)
        return found

    def across(self, aside: DataFrame, found: DataFrame) -> DataFrame:
        """Links between components among the members set aside; written.

        Bands' values of one component, or of one member, are settled. The members of
        the others are joined by their rarest shingles: with shingles ordered by
        how frequent they are among these members, a pair that is similar enough
        has a shingle in common among the first of the smaller set (index) and
        of the larger one (probe), whose places leave room for the overlap that
        is needed. That loses nothing, and text that very many have in common
        comes last and is no reason to meet. Shingles of one component are
        dropped before pairs are made.
        """
        labelled = aside.join(found.withColumnRenamed("node", "one"), "one", "left").select("bucket", "one", F.coalesce("component", "one").alias("component"))
        mixed = labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")
        members, path = written(labelled.join(mixed, "bucket").select("one", "component").distinct(), "mixed")
        if members.isEmpty():
            drop(self.spark, path)
            return self.spark.createDataFrame([], "one long, two long")
        texts, texts_at = self.texts_of(members.select(F.col("one").alias("doc_id")))
        counts = texts.mapInArrow(_frequencies(self.width), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
        often = np.zeros(BINS, np.int64)
        often[[r["bin"] for r in counts]] = [r["n"] for r in counts]
        first, places = written(texts.mapInArrow(_prefixes(self.width, self.percent, often), _PREFIX).join(members, "one"), "prefixes")
        shared = first.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("index").alias("any")).where("least <> most and any")
        first = first.join(shared.select("shingle"), "shingle")
        small = first.where("index").select("shingle", *(F.col(c).alias(f"{c}1") for c in ("one", "component", "n", "place")))
        large = first.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("one", "component", "n", "place")))
        order = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("one1") < F.col("one2")))
        sizes = 100 * F.col("n1") >= self.percent * F.col("n2")
        room = (100 + self.percent) * F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2")) >= self.percent * (F.col("n1") + F.col("n2"))
        pairs = small.join(large, "shingle").where((F.col("component1") != F.col("component2")) & order & sizes & room)
        pairs = pairs.select(F.least("one1", "one2").alias("one"), F.greatest("one1", "one2").alias("two")).distinct()
        links, links_at = self.links(pairs)
        self.paths.append(links_at)
        drop(self.spark, path, places, texts_at)
        return links


#: Bins that shingles are counted in, to order them by frequency; the counts go to the driver and to all tasks.
BINS = 1 << 16
_PREFIX = "one long, shingle long, n int, place int, index boolean"
_PREFIX_ARROW = pa.schema([("one", pa.int64()), ("shingle", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("index", pa.bool_())])


def _bins(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype(np.int64) % BINS


def _frequencies(width: int):
    """How many sets have a shingle in each bin; a row a bin and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in slices(batches, 1):
            for own in shingle_hashes(utf8(batch.column(1)), width):
                total += np.bincount(_bins(own), minlength=BINS) if len(own) > BINS // 8 else 0
                if len(own) <= BINS // 8:
                    np.add.at(total, _bins(own), 1)
        used = np.flatnonzero(total)
        yield record(pa.schema([("bin", pa.int32()), ("n", pa.int64())]), used.astype(np.int32), total[used])

    return run


def first_shingles(shingles: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set that a pair must meet in: those of a larger set, of which the first are those of a smaller one."""
    n = len(shingles)
    ordered = shingles[np.lexsort((shingles, often[_bins(shingles)]))]
    probe = n - -(-percent * n // 100) + 1
    index = n - -(-2 * percent * n // (100 + percent)) + 1
    return ordered[:probe], index


def _prefixes(width: int, percent: int, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for doc_id, own in zip(ids, shingle_hashes(utf8(batch.column(1)), width)):
                first, index = first_shingles(own, often, percent)
                place = np.arange(len(first), dtype=np.int32)
                out.append((np.full(len(first), doc_id, np.int64), first.view(np.int64), np.full(len(first), len(own), np.int32), place, place < index))
            if out:
                yield record(_PREFIX_ARROW, *(np.concatenate(x) for x in zip(*out)))

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of near-duplicates: doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; the set of a document
    is its distinct shingles of width words, with fewer words the whole
    sequence. Documents are linked if their intersection is at least percent
    hundredths of their union. component_id is the smallest id reachable, kept
    tells whether it is the document's own.

    Null, empty and blank texts have no shingles and are linked with nothing.
    Rows without an id are linked with nothing, have no component_id and are
    kept. Rows repeated whole are one document, each of them returned. Other
    columns are not read. No rows give no rows.
    """
    return _labelled(_Run(docs, id_col, text_col, width, percent))


def _labelled(run: _Run) -> DataFrame:
    """The result of a search; run.paths are the tables that it reads."""
    found, found_at = run.candidates()
    edges, edges_at = run.links(found.where("bucket is null").select("one", "two").distinct())
    labels = components(edges, run.paths)
    aside = found.where("bucket is not null").select("bucket", "one").distinct()
    more = run.across(aside, labels)
    drop(run.spark, found_at, edges_at)
    classes = run.classes.select("id", "digest").join(labels.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    if not more.isEmpty():
        # components join components: those are few
        first = more.join(labels.withColumnRenamed("node", "one"), "one", "left").select(F.coalesce("component", "one").alias("one"), "two")
        joined = first.join(labels.withColumnRenamed("node", "two"), "two", "left").select("one", F.coalesce("component", "two").alias("two"))
        merged = components(joined, run.paths).select(F.col("node").alias("component"), F.col("component").alias("to"))
        classes = classes.join(merged, "component", "left").select("digest", F.coalesce("to", "component").alias("component"))
    joined = run.signed.select("doc_id", "n", "digest").join(classes, "digest", "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id; all columns as they are.

    Documents that are linked with nothing stay, so do rows without an id.
    """
    run = _Run(docs, id_col, text_col, width, percent)
    gone, _ = written(_labelled(run).where(~F.col("kept")).select("doc_id"), "near-copies")
    drop(run.spark, *run.paths)
    return without(docs, gone, id_col)


#: The same for width 2 in SQL, by all pairs that share a shingle; for small tables.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, case when len(ws) = 1 then ws[1] else ws[i] || ' ' || ws[i + 1] end shingle from (select doc_id, ws, unnest(range(1, greatest(len(ws), 2))) i from w where len(ws) > 0)),
n as (select doc_id, count(*) size from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.size + b.size - c)),
r(doc_id, reach) as (select doc_id, doc_id from w union select r.doc_id, e.y from r join e on e.x = r.reach),
m as (select doc_id, min(reach) component_id from r group by doc_id)
select m.doc_id, coalesce(size, 0) n_shingles, component_id, component_id = m.doc_id kept from m left join n on n.doc_id = m.doc_id
"""
