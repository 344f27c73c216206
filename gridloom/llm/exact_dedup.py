"""Exact dedup by a tree-merge of sorted digest runs.

Every scan partition makes a *run*: the digests of its texts in ascending
order, each once, with the number of its rows, the row that would stay and the
number of the run. Runs are exchanged in binomial rounds (a butterfly of radix
``RADIX``): a run sits in a slot; in round r the entry with digit d as its
r-th digest digit moves to the slot whose r-th digit is d. So each slot sends
all but 1/RADIX of its run to RADIX-1 partners, and merges what it gets, RADIX
sorted pieces, into one run, equal digests becoming one entry that keeps the
best row. After the last round a slot holds the only run of its digest range:
no task ever holds more than its share, and a digest that a third of all rows
have is one entry a run from the first level on.

Answers go straight back to the runs an entry came from, of which it keeps the
numbers, and are joined there with the rows of that run, so that a frequent
digest is spread over as many keys as there are runs.

An entry's digest is SHA-256 of the normalised text; entries merge only when
the length of the normalised text and an independent second digest agree too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import BLANKS, record, slices, split_by_ids, unused, utf8
from gridloom.session import drop, let_workers_import, written

#: Partners in a round, itself included.
RADIX = 4

_LOCAL = "run int, pos long, doc_id long, chars long, sha binary, size long, check binary"
_LOCAL_ARROW = pa.schema([("run", pa.int32()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("chars", pa.int64()), ("sha", pa.binary()), ("size", pa.int64()), ("check", pa.binary())])
_ENTRY = "slot int, sha binary, size long, check binary, chars long, doc_id long, run int, pos long, rows long, runs array<int>"
_ENTRY_ARROW = pa.schema(
    [("slot", pa.int32()), ("sha", pa.binary()), ("size", pa.int64()), ("check", pa.binary()), ("chars", pa.int64()), ("doc_id", pa.int64()), ("run", pa.int32()), ("pos", pa.int64()), ("rows", pa.int64()), ("runs", pa.list_(pa.int32()))]
)
_LAST = 1 << 63


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, pos = TaskContext.get().partitionId(), 0
    for batch in slices(batches, 1):
        texts = utf8(batch.column(1))
        chars = pa.compute.utf8_length(batch.column(1)).fill_null(0)
        short = [x.translate(None, BLANKS) for x in texts]
        n = len(texts)
        yield record(
            _LOCAL_ARROW, [run] * n, range(pos, pos + n), batch.column(0), chars.cast(pa.int64()), [hashlib.sha256(x).digest() for x in short], [len(x) for x in short], [hashlib.blake2b(x, digest_size=8).digest() for x in short]
        )
        pos += n


def _best(entry: tuple) -> tuple:
    """Most code points, then smallest id (null last), then place."""
    chars, doc_id, run, pos = entry[4:8]
    return -chars, _LAST if doc_id is None else doc_id, run, pos


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge entries that arrive in the order of (slot, digest, size, check)."""

    def entries():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[tuple] = []
    for key, same in groupby(entries(), key=itemgetter(0, 1, 2, 3)):
        best = next(same)
        rows, runs = best[8], set(best[9])
        for entry in same:
            rows += entry[8]
            runs.update(entry[9])
            if _best(entry) < _best(best):
                best = entry
        out.append((*key, *best[4:8], rows, sorted(runs)))
        if len(out) >= 4096:
            yield record(_ENTRY_ARROW, *zip(*out))
            out = []
    if out:
        yield record(_ENTRY_ARROW, *zip(*out))


def _sorted_merge(entries: DataFrame) -> DataFrame:
    """The pieces that meet in a slot are sorted runs: merge them."""
    return entries.repartition("slot").sortWithinPartitions("slot", "sha", "size", "check").mapInArrow(_merged, _ENTRY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX) -> DataFrame:
    """Group equal texts and choose the row that stays.

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]. The row
    with the most code points in its original text, then the smallest id,
    stays. Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256.

    Null text counts as empty, so null, empty and blank texts form one group.
    A null id comes after every other and is returned as null. Of rows repeated
    whole, ids included, exactly one is kept. Other columns of docs, whatever
    their names, are not read. No rows give no rows.
    """
    return _grouped(docs, id_col, text_col, radix)[0]


def _grouped(docs: DataFrame, id_col: str, text_col: str, radix: int) -> tuple[DataFrame, str]:
    """The groups, and the path of the table that they are read from."""
    spark = docs.sparkSession
    let_workers_import(spark)
    rows, path = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_digests, _LOCAL), "digests")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds, slots = 1, radix
    while slots < partitions:
        rounds, slots = rounds + 1, slots * radix
    entries = rows.select(
        (F.col("run") % slots).cast("int").alias("slot"), "sha", "size", "check", "chars", "doc_id", "run", "pos", F.lit(1).cast("long").alias("rows"), F.array("run").alias("runs")
    )
    entries = entries.sortWithinPartitions("slot", "sha", "size", "check").mapInArrow(_merged, _ENTRY)
    number = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
    for r in range(rounds):
        unit = radix**r
        was = F.floor(F.col("slot") / unit) % radix
        will = F.floor(number / unit) % radix
        entries = entries.withColumn("slot", (F.col("slot") + (will - was) * unit).cast("int"))
        entries = _sorted_merge(entries)
    shared = entries.where("rows > 1").select(
        F.explode("runs").alias("run"), "sha", "size", "check", F.col("rows").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("run").alias("keep_run"), F.col("pos").alias("keep_pos")
    )
    joined = rows.join(shared, ["run", "sha", "size", "check"], "left")
    alone = F.col("group_size").isNull()
    out = joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("keep_run") == F.col("run")) & (F.col("keep_pos") == F.col("pos")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return out, path


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay; all columns as they are. Rows repeated whole become one."""
    found, path = _grouped(docs, id_col, text_col, RADIX)
    told = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("some"), F.min("kept").alias("every"))
    id_, sha, some, own, own_sha, place = unused(docs, "_id", "_sha", "_some", "_own", "_own_sha", "_place")
    told, _ = written(told.where(~F.col("every")).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), F.col("some").alias(some)), "copies")
    drop(docs.sparkSession, path)
    maybe, surely = split_by_ids(docs, told.select(id_), id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mine = maybe.withColumns({own: F.col(id_col).cast("long"), own_sha: F.sha2(F.translate(text, BLANKS.decode(), "").cast("binary"), 256)})
    joined = mine.join(told, F.col(own).eqNullSafe(F.col(id_)) & (F.col(own_sha) == F.col(sha)), "left")
    # of rows that have id and normalised text in common one stays; alone they need no shuffle
    order = Window.partitionBy(own, own_sha).orderBy(F.char_length(text).desc(), text)
    kept = joined.where(F.coalesce(F.col(some), F.lit(True))).withColumn(place, F.row_number().over(order)).where(F.col(some).isNull() | (F.col(place) == 1))
    return surely.unionByName(kept.select(*(F.col(f"`{c}`") for c in docs.columns)))


ORACLE = r"""
with t as (select doc_id, length(coalesce(text, '')) chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256 from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by text_sha256) group_size, first_value(doc_id) over w = doc_id kept, text_sha256
from t window w as (partition by text_sha256 order by chars desc, doc_id)
"""
