"""Language ID by error-correcting output codes.

Each language has a codeword of +1 and -1. One binary classifier a bit,
logistic over hashed byte n-gram frequencies, predicts that bit. Decoding is
loss-weighted: a language's loss is the sum over bits of the logistic loss of
its codeword's sign against the classifier's margin, weighted by how reliable
the bit proved in training; the language of least loss is chosen, and the text
is flagged as ambiguous when the runner-up is about as near.

The classifiers are fitted on the driver on a bounded sample of labelled rows:
at most SAMPLE_ROWS, evenly over the languages, those with the smallest hash of
their id. Only their n-gram counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import first_of_each, record, remainder, slices, utf8
from gridloom.session import let_workers_import

#: Bound on the labelled rows that the classifiers are fitted on.
SAMPLE_ROWS = 4000
#: Buckets that byte bigrams and trigrams are hashed into.
BUCKETS = 4096
#: A text is ambiguous when its score is below this.
AMBIGUOUS = 0.5
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, other ASCII as a blank, the rest as it is.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_OUT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def _counts(text: bytes) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    x = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    two = x[:-1] | (x[1:] << np.uint32(8))
    three = two[:-1] | (x[2:] << np.uint32(16))
    total = np.bincount((two * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)) >> np.uint32(20), minlength=BUCKETS)
    return total + np.bincount((three * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=BUCKETS)


def features(texts: Iterable[bytes]) -> np.ndarray:
    """Square roots of the n-gram frequencies: unit rows whatever the length of a text."""
    x = np.stack([_counts(t) for t in texts]).astype(np.float32)
    return np.sqrt(x / x.sum(axis=1, keepdims=True))


def codewords(languages: int) -> np.ndarray:
    """Codewords (languages x bits): all splits in two for few languages, else the best of some random codes."""
    if languages <= 2:
        return np.array([[1.0], [-1.0]])[:languages]
    if languages <= 6:
        split = np.arange(1, 2 ** (languages - 1))
        return np.stack([np.where(split >> i & 1, -1.0, 1.0) for i in range(languages)])
    bits, best, far = int(np.ceil(10 * np.log2(languages))), None, -1
    rng = np.random.default_rng(5)
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(languages) * bits
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each language for each row."""
        margin = x @ self.weights + self.bias
        return np.logaddexp(0, -margin) @ (self.trust[:, None] * (self.code.T > 0)) + np.logaddexp(0, margin) @ (self.trust[:, None] * (self.code.T < 0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Nearest language and its share of exp(-loss) among all."""
        loss = self.losses(x)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        best = loss.argmin(axis=1)
        return [self.languages[i] for i in best], np.take_along_axis(share, best[:, None], 1)[:, 0] / share.sum(axis=1)


def fit(x: np.ndarray, labels: list[str], rounds: int = 150, decay: float = 1e-5) -> Model:
    """Fit the bits by accelerated gradient steps on the logistic loss; languages weigh alike."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    at = np.searchsorted(languages, labels)
    target = code[at].astype(np.float32)
    share = (1 / np.bincount(at)[at] / len(languages)).astype(np.float32)[:, None]
    weights, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    fast_w, fast_b, step = weights, bias, np.float32(2.0)
    for i in range(rounds):
        pull = share * target / (1 + np.exp(target * (x @ fast_w + fast_b)))
        new_w, new_b = fast_w + step * (x.T @ pull - decay * fast_w), fast_b + step * pull.sum(axis=0)
        push = np.float32(i / (i + 3))
        fast_w, fast_b, weights, bias = new_w + push * (new_w - weights), new_b + push * (new_b - bias), new_w, new_b
    right = (share * (target * (x @ weights + bias) > 0)).sum(axis=0)
    return Model(languages, code, weights, bias, np.clip(2 * right - 1, 0.01, 1))


def labelled_sample(docs: DataFrame, lang: Column, teach: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts and labels of at most rows rows, as many of each language, by the hash of their id."""
    known = docs.where(lang.isNotNull() & teach).select("doc_id", lang.alias("lang"))
    languages = known.select(F.approx_count_distinct("lang")).first()[0]
    each = max(1, rows // max(1, languages))
    found = first_of_each(known.withColumn("hash", F.xxhash64("doc_id")), "lang", ["hash", "doc_id"], each)
    chosen = found.orderBy("hash", "doc_id", "lang").limit(rows).groupBy(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang")).agg(F.count("*").alias("n"))
    own = docs.where(lang.isNotNull() & teach).select("doc_id", lang.alias("lang"), "text", F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang"))
    met = own.join(F.broadcast(chosen), same).withColumn("key", F.struct("doc_id", "lang"))
    # ids may repeat: of each as many rows as were chosen
    place = F.row_number().over(Window.partitionBy("key").orderBy("text_hash"))
    return first_of_each(met, "key", ["text_hash"], each).withColumn("place", place).where("place <= n").select("lang", "text")


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())])
    for batch in slices(batches, 1):
        rows = [_counts(t) for t in utf8(batch.column(1))]
        at = [np.flatnonzero(r) for r in rows]
        yield record(schema, batch.column(0).cast(pa.string()), [a.astype(np.uint16).tobytes() for a in at], [r[a].astype(np.uint32).tobytes() for a, r in zip(at, rows)])


def train(docs: DataFrame, teach: Column, rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on a bounded sample of the rows for which teach holds; None without any."""
    let_workers_import(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = labelled_sample(plain, F.col("lang"), teach, rows).mapInArrow(_sample_counts, "lang string, at binary, n binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    x, labels = np.zeros((len(got), BUCKETS), np.float32), [r["lang"] for r in got]
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.uint32)
    del got
    x /= x.sum(axis=1, keepdims=True)
    return fit(np.sqrt(x, out=x), labels)


def identify(docs: DataFrame, modulus: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Language of each whole text: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from text and lang of rows whose crc32(doc_id as text) mod modulus
    is not held_out. lang_pred is ``und``, with score 0, for null texts and
    those without a letter, and for all rows if there is nothing to learn from;
    score is otherwise the share of the chosen language. Null ids count as
    empty text in the fold and are returned as null; repeated rows are judged
    alike; source and other columns are never read. Of languages of equal loss
    the first by name is chosen.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    model = train(docs, remainder(F.col("doc_id"), modulus) != held_out, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            named, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if model and t is not None and _LETTER.search(t)]
            for a in range(0, len(at), 1024):
                part = at[a : a + 1024]
                got, share = model.predict(features(texts[i].encode("utf-8", "surrogatepass") for i in part))
                for i, g in zip(part, got):
                    named[i] = g
                score[part] = share
            yield record(_OUT_ARROW, batch.column(0), batch.column(2), named, score, score < AMBIGUOUS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"))
    return rows.mapInArrow(run, _OUT)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs whose language is determined and not ambiguous; all columns as they are.

    Learns as identify does. Rows with null text or without a letter go. If
    there is nothing to learn from, no language is determined and all go.
    """
    let_workers_import(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model, at = train(plain, remainder(F.col("doc_id"), 4) != 2, sample_rows), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if model and t is not None and _LETTER.search(t)]
            keep = np.zeros(len(texts), bool)
            for a in range(0, len(known), 1024):
                part = known[a : a + 1024]
                keep[part] = model.predict(features(texts[i].encode("utf-8", "surrogatepass") for i in part))[1] >= AMBIGUOUS
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
