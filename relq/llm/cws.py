"""Document fingerprints by consistent weighted sampling.

A document's terms are its word pairs (the whole word sequence where it has one word), weighted by how often each
occurs; a term's 64-bit hash is its dimension. For each of the samples a dimension has two Gamma(2, 1) variables and
a uniform one, drawn from the hash and so the same for all documents; the sample is the dimension with the least hash value, with the level
to which its weight was rounded. The share of equal samples estimates the generalised Jaccard similarity of the
weights: the sum of the smaller ones divided by that of the larger ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Without a number of dimensions each 64-bit hash of a term is one.
DIMENSIONS, SAMPLES = None, 64
#: Terms whose samples are drawn at a time.
CHUNK = 512
BUCKET_DOCS, BUCKETS = 4096, 10_000
WORDS_KEPT = 300_000
_UNIT = np.float32(2.0**-32)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Sampler(dict):
    """Maps a word (bytes) to a hash of it; draws the random variables of any term from the term's hash, or holds
    those of a given number of dimensions."""

    def __init__(self, samples: int, dimensions: int | None, seed: int) -> None:
        self.samples, self.dimensions = samples, dimensions
        draw = np.random.Generator(np.random.PCG64(seed))
        if dimensions is None:
            self.salts = draw.integers(0, 1 << 64, (2, samples), np.uint64)
        else:
            shape = (dimensions, samples)
            gamma = lambda: -np.log((1 - draw.random(shape, np.float32)) * (1 - draw.random(shape, np.float32)) + np.float32(1e-30))
            self.r, self.beta = gamma(), draw.random(shape, np.float32)
            self.log_c = np.log(gamma() + np.float32(1e-30))

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 1) >> 2
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h
        return h

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions and weights of a text, by dimension."""
        words = text.encode("utf-8", "surrogatepass").split()
        ids = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:] if len(ids) > 1 else ids
        pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(pairs if self.dimensions is None else (pairs >> np.uint64(40)) % np.uint64(self.dimensions), return_counts=True)

    def variables(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, beta and the logarithm of c, a row for each term and a column for each sample."""
        if self.dimensions is not None:
            return self.r[terms], self.beta[terms], self.log_c[terms]
        first, second = (mixed(terms[:, None] ^ salt) for salt in self.salts)

        def gamma(x: np.ndarray) -> np.ndarray:
            halves = x.view(np.uint32).astype(np.float32)
            halves += np.float32(0.5)
            out = halves[:, ::2] * halves[:, 1::2]
            out *= _UNIT * _UNIT
            np.negative(np.log(out, out=out), out=out)
            return np.maximum(out, np.float32(1e-30), out=out)

        r, c = gamma(first), gamma(second)
        first += second
        first *= np.uint64(0xD6E8FEB86659FD93)
        first >>= np.uint64(40)
        beta = first.astype(np.float32)
        beta *= np.float32(2.0**-24)
        return r, beta, np.log(c, out=c)

    def fingerprint(self, text: str) -> np.ndarray:
        """16 bits of each sample; none for a text without words."""
        where, weight = self.terms(text)
        if not len(where):
            return np.zeros(0, np.uint16)
        least, best, level = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int64)
        for k in range(0, len(where), CHUNK):
            own, w = where[k : k + CHUNK], weight[k : k + CHUNK]
            r, beta, log_c = self.variables(own)
            value = log_c - r * (1 - beta)  # at weight 1, whose level is 0
            more = np.flatnonzero(w > 1)
            if len(more):
                t = np.zeros(r.shape, np.float32)
                t[more] = np.floor(np.log(w[more].astype(np.float32))[:, None] / r[more] + beta[more])
                value[more] = log_c[more] - r[more] * (t[more] - beta[more] + 1)
            i, column = value.argmin(0), np.arange(self.samples)
            low = value[i, column]
            new = low < least
            least[new], best[new], level[new] = low[new], own[i][new], t[i, column][new].astype(np.int64) if len(more) else 0
        out = (best * np.uint64(0x9E3779B97F4A7C15) + level.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return (out >> np.uint64(48)).astype(np.uint16)


@lru_cache(1)
def sampler(samples: int, dimensions: int | None, seed: int) -> Sampler:
    return Sampler(samples, dimensions, seed)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; texts without words are alike to each other only."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def written(fp: np.ndarray) -> str:
    return fp.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, samples: int = SAMPLES, dimensions: int | None = DIMENSIONS, seed: int = 5, text_col: str = "text") -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (hexadecimal, 4 digits for each sample).

    Null and blank texts have the empty fingerprint. Ids may be null, rows may repeat, an empty table gives none;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(samples, dimensions, seed)
        for b in batches:
            found = [written(own.fingerprint(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (bucket, k, guest, doc_id, text): buckets of neighbouring ids, descending, sorted in their partitions.

    A guest is the first document of the next bucket (of the first after the last), so that each document's
    successor follows it in its own bucket. Bucket borders are quantiles of the ids; no more than BUCKETS are made.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = own.count()
    buckets = min(max(1, math.ceil(n / BUCKET_DOCS)), BUCKETS)
    shares = [i / buckets for i in range(1, buckets)]
    borders = sorted(set(own.agg(F.percentile_approx("k", F.array(*map(F.lit, shares)), 10 * buckets).alias("q")).first().q or ()), reverse=True) if shares else []
    bucket = F.lit(len(borders)) - _at_most(borders)
    own = own.withColumn("bucket", bucket.cast("int"))
    heads = [tuple(r) for r in own.groupBy("bucket").agg(F.max("k")).orderBy("bucket").collect()]
    to = spark.createDataFrame([(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)], "k long, before int")
    own = own.join(F.broadcast(to), "k", "left")  # a row for each bucket
    stay, visit = F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    own = own.select("k", "doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(stay)).otherwise(F.array(stay, visit))).alias("at"))
    own = own.select("at.bucket", "at.guest", "k", "doc_id", "text")
    return own.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "guest", F.desc("k"), "text")


def _at_most(borders: list[int]):
    """How many of the borders are at most k, found by halving."""
    lows = F.array(*map(F.lit, sorted(borders))).cast("array<long>")
    steps = [1 << i for i in reversed(range(len(borders).bit_length()))]
    if not steps:
        return F.lit(0)
    further = lambda at, s: F.when((at + s <= len(borders)) & (F.get(lows, at + s - 1) <= F.col("k")), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        own = sampler(SAMPLES, DIMENSIONS, 5)
        held = None
        for b in batches:
            rows = []
            for bucket, guest, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if guest and (held is None or held[0] != bucket):
                    continue  # only the first guest follows a bucket's last document
                fp = own.fingerprint(text)
                if held is not None and held[0] == bucket:
                    _, id_, before, before_fp = held
                    n = len(before)
                    edited = before[: n - n // 3] + text[: n // 3]
                    edited_fp = own.fingerprint(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((id_, n, sha, written(before_fp), written(edited_fp), likeness(before_fp, edited_fp), likeness(before_fp, fp)))
                held = None if guest else (bucket, doc_id, text, fp)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows = in_order(table(spark, sf_dir, "documents")).select("bucket", "guest", "doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
