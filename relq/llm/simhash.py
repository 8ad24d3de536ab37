"""SimHash fingerprints, exact Hamming links through vantage-point trees, and near-duplicate removal.

Links: the distinct fingerprints are dealt to shards by the top of a vantage-point tree, whose pivots come from a
bounded sample. A fingerprint near a shell border is dealt to both sides: two fingerprints within the radius of each
other differ by no more than the radius in their distance to any pivot, so at every node at least one side receives
both. Each shard continues the same tree in memory, compares the fingerprints of its small leaves exactly, and
returns a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_names, likely_among, materialize, new_folder, scratch, small_batches, table

SEED = 42
#: Fingerprints from which the top of the tree is made: at least, at most, and for each shard in between.
SAMPLE, SAMPLE_MOST, SAMPLE_EACH = 4096, 1 << 18, 32
#: Fingerprints that a shard should hold.
SHARD = 20_000
LEAF = 256
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_digests(text: str | None, size: int) -> bytes:
    """The XXH64 digests (8 bytes each, in order, repeats included) of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return b""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())])


def fingerprint(digests: bytes) -> int:
    """64 bits, each set where over half the digests have it; no digests: 0."""
    n = len(digests) // 8
    if not n:
        return 0
    rows, ones = np.frombuffer(digests, np.uint8).reshape(n, 8), np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        ones += np.unpackbits(rows[k : k + CHUNK], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle_words: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long. Null and blank texts have fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_digests(t, shingle_words)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed(fps))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def distances(points: np.ndarray, pivot) -> np.ndarray:
    return np.bitwise_count(points ^ pivot).astype(np.int16)


def split(points: np.ndarray, radius: int) -> tuple | None:
    """A node (pivot, threshold, inner border goes out?) for these points, or None if none makes both sides smaller."""
    best, n = None, len(points)
    for pivot in points[np.linspace(0, n - 1, 8, dtype=int)]:
        held = np.cumsum(np.bincount(distances(points, pivot), minlength=65 + radius))
        for t in range(0, 64):
            inner = held[t]
            out_copies, in_copies = inner - (held[t - radius] if t >= radius else 0), held[t + radius] - inner
            sides = (inner, n - inner + out_copies) if out_copies <= in_copies else (inner + in_copies, n - inner)
            if max(sides) < 0.9 * n and (best is None or sum(s * np.log2(s + 1) for s in sides) < best[0]):
                best = (sum(s * np.log2(s + 1) for s in sides), (pivot, t, bool(out_copies <= in_copies)))
    return best and best[1]


def sides(points: np.ndarray, node: tuple, radius: int) -> tuple[np.ndarray, np.ndarray]:
    pivot, t, outward = node
    d = distances(points, pivot)
    return (d <= t, d > t - radius) if outward else (d <= t + radius, d > t)


def grow(points: np.ndarray, radius: int, leaf: int) -> tuple:
    """A tree over a sample: ("leaf",) or (pivot, threshold, outward, inner tree, outer tree)."""
    node = split(points, radius) if len(points) > leaf else None
    if node is None:
        return ("leaf",)
    a, b = sides(points, node, radius)
    return (*node, grow(points[a], radius, leaf), grow(points[b], radius, leaf))


def deal(tree: tuple, points: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """(shard, indices of its points) for every shard that gets any."""
    found: list[tuple[int, np.ndarray]] = []

    def go(node: tuple, rows: np.ndarray, number: int) -> None:
        if len(node) == 1:
            if len(rows):
                found.append((number, rows))
            return
        a, b = sides(points[rows], node[:3], radius)
        go(node[3], rows[a], 2 * number)
        go(node[4], rows[b], 2 * number + 1)

    go(tree, np.arange(len(points)), 1)
    return found


def _merge(parent: dict[int, int], a: int, b: int) -> None:
    roots = []
    for x in (a, b):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        roots.append(x)
    parent[max(roots)] = min(roots)


def forest(points: np.ndarray, radius: int, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Index pairs (i, root) that join exactly the points linked, directly or through others, within the radius."""
    parent: dict[int, int] = {}

    def compare(rows: np.ndarray) -> None:
        for k in range(0, len(rows), 1024):  # only a set that no pivot splits is longer than a leaf
            part = rows[k : k + 1024]
            for m in range(k, len(rows), 4096):
                other = rows[m : m + 4096]
                near = np.bitwise_count(points[part][:, None] ^ points[other][None, :]) <= radius
                label = np.where(near, other[None, :], np.iinfo(np.int64).max).min(1)
                while True:
                    back = np.where(near, label[:, None], np.iinfo(np.int64).max).min(0)
                    again = np.minimum(label, np.where(near, back[None, :], np.iinfo(np.int64).max).min(1))
                    if (again == label).all():
                        break
                    label = again
                for i in np.flatnonzero(label != part):
                    if label[i] < np.iinfo(np.int64).max:
                        _merge(parent, int(part[i]), int(label[i]))
                for j in np.flatnonzero((back != other) & (back < np.iinfo(np.int64).max)):
                    _merge(parent, int(other[j]), int(back[j]))

    todo = [np.arange(len(points), dtype=np.int64)]
    while todo:
        rows = todo.pop()
        node = split(points[rows], radius) if len(rows) > leaf else None
        if node is None:
            compare(rows)
        else:
            todo += [rows[s] for s in sides(points[rows], node, radius)]
    out = []
    for i in list(parent):
        root = i
        while parent.get(root, root) != root:
            root = parent[root]
        if root != i:
            out.append((i, root))
    return out


def links(fps: DataFrame, radius: int = 2, shard_rows: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Distinct fingerprints (fp long) -> forest edges (a, b): their components are those of all links within the radius."""
    spark = fps.sparkSession
    total = fps.count()
    sample = min(SAMPLE_MOST, max(sample, SAMPLE_EACH * total // shard_rows))
    points = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    tree = grow(points, radius, max(16, int(len(points) * shard_rows / max(total, 1)))) if total > shard_rows else ("leaf",)
    where = spark.sparkContext.broadcast(tree)  # at most one node for each sampled fingerprint

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for shard, rows in deal(where.value, own.view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int64)), pa.array(own[rows])], ["shard", "fp"])

    def in_shard(rows):
        own = np.unique(rows.column("fp").to_numpy())
        found = forest(own.view(np.uint64), radius)
        a, b = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(own[a]), "b": pa.array(own[b])})

    return fps.select("fp").mapInArrow(to_shards, "shard long, fp long").groupBy("shard").applyInArrow(in_shard, "a long, b long")


def clusters(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable through links within the radius, its own included. Null and blank
    texts share fingerprint 0; repeated rows stay; a null doc_id is no candidate for the smallest (null if alone);
    an empty table gives no rows; other columns are ignored.
    """
    own = materialize(fingerprints(docs, shingle_words), "fp")
    least = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    label = connected_components(links(least, radius))
    of = least.join(label.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = materialize(of, "labels")
    smallest = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return own.join(of.join(smallest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Of _sharing_prefixes: shingles at most that are ordered by the number of documents that have them.
FREQUENT = 200_000
#: Of near_duplicates: hash values of a signature, values of a band, bits within which fingerprints are linked, and the
#: estimate below which a pair is none: one at 0.8 falls below it with a chance of 1 in 10^9.
SIGNATURE, BAND, RADIUS, LOW = 120, 5, 3, 0.55
#: Pairs of one document that a task should see together.
HUB = 256
_MIX = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, SIGNATURE, np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper half of the least product of a shingle's hash with each of the odd numbers of _MIX."""
    out = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[k : k + 4096, None] * _MIX).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def row_key(docs: DataFrame):
    """The id of a document, or where it has none a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in b.columns)):
                digests = shingle_digests(text, words)
                own = np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))
                sig = signature(own)
                bands = [xxhash.xxh64_intdigest(sig[k : k + BAND].tobytes(), k) for k in range(0, SIGNATURE, BAND)] if len(own) else []
                rows.append((key, xxhash.xxh64_intdigest(own.tobytes(), 1) >> 1, signed([fingerprint(digests)])[0], sig.tobytes(), signed(bands).tolist()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["key", "same", "fp", "sig", "bands"])

    own = docs.select(row_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "key long, same long, fp long, sig binary, bands array<long>")


def _keys(pairs: DataFrame) -> DataFrame:
    """(key) of the documents in these pairs (rep, other)."""
    return materialize(pairs.select(F.explode(F.array("rep", "other")).alias("key")).distinct(), "keys")


def _compared(pairs: DataFrame, side: DataFrame, like, least: float) -> DataFrame:
    """Those of the pairs (rep, other, parts) whose values in side (key, own) are so alike, with like.

    other may be in a great many pairs: its value goes out parts times, and its pairs meet one of these each. Values
    that no pair asks for stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [like(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.float64())], ["rep", "other", "parts", "like"])

    side = likely_among(side, ["key"], _keys(pairs))
    often = pairs.groupBy("other").agg(F.max("parts").alias("most"))
    spread = side.select(F.col("key").alias("other"), F.col("own").alias("y")).join(often, "other")
    spread = spread.select("other", "y", F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("part"))
    dealt = pairs.select("rep", "other", "parts", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int").alias("part"))
    own = dealt.join(spread, ["other", "part"]).join(side.select(F.col("key").alias("rep"), F.col("own").alias("x")), "rep")
    return own.select("rep", "other", "parts", "x", "y").mapInArrow(run, "rep long, other long, parts int, like double").where(F.col("like") >= least)


def estimate(x: bytes, y: bytes) -> float:
    return float((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean())


def jaccard(x: bytes, y: bytes) -> float:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _sets(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(key, own): the sets of shingle hashes of the documents with these keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.frombuffer(shingle_digests(t, words), np.uint64)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["key", "own"])

    texts = likely_among(docs.select(row_key(docs).alias("key"), F.col("text").cast("string").alias("text")), ["key"], keys)
    return materialize(texts.mapInArrow(run, "key long, own binary").dropDuplicates(["key"]).join(keys, "key", "left_semi"), "sets")


def _uncovered(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(key, component) of the members of bands that hold several components and pairs not compared: of up to three
    members each pair has the least or the largest."""
    of = label.select(F.col("node").alias("rep"), "component")
    own = shared.where("members > 3").join(of, "rep", "left").select("n", "band", "rep", F.coalesce("component", "rep").alias("component"))
    own = materialize(own, "members")
    mixed = own.groupBy("n", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("n", "band")
    return own.join(mixed, ["n", "band"]).select(F.col("rep").alias("key"), "component").distinct()


def prefix(own: np.ndarray, often: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of all sets: rare ones before the sorted often (by rank). As many as may
    hold the first shingle that the set has in common with one so similar."""
    n, order = len(own), np.argsort(own, kind="stable")
    if len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        order = np.lexsort((own, np.where(often[at] == own, rank[at], 0)))
    return own[order[: n - math.ceil(similarity * n - 1e-6) + 1]]


def _sharing_prefixes(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (rep, other, parts) of different components, among them each that is so similar.

    All sets are ordered alike, shingles of many documents last; FREQUENT bounds how many have their place by count,
    which changes the cost and not the result. At the first shingle that two sets share, each has in common with the
    other no more than what is left of it: if that is too little for sets of their sizes, they are not so similar. The
    test needs component, size and place only, so members of a component that are alike in these meet others as one.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(own, np.int64))], ["shingle"])

    often = sets.select("own").mapInArrow(shingles, "shingle long").groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(FREQUENT).toPandas()
    values = often["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    known = sets.sparkSession.sparkContext.broadcast((values[order], often["count"].to_numpy(np.int64)[order]))  # at most FREQUENT shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, component, own in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(own, np.uint64)
                if len(own):
                    found = prefix(own, *known.value, similarity)
                    each = lambda v: pa.array(np.full(len(found), v, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), each(component), each(key), each(len(own)), pa.array(np.arange(len(found)))], ["shingle", "component", "key", "size", "place"])

    posted = rest.join(sets, "key").select("key", "component", "own").mapInArrow(run, "shingle long, component long, key long, size long, place long")
    posted = materialize(posted, "posted")
    mixed = posted.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
    posted = materialize(posted.join(mixed, "shingle"), "mixed")
    kinds = posted.select("shingle", "component", "size", "place").distinct()
    one = lambda df, side: df.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in df.columns if c != "shingle"))
    share = similarity / (1 + similarity)
    enough = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= share * (F.col("size_a") + F.col("size_b")) - 1e-6
    met = materialize(one(kinds, "a").join(one(kinds, "b"), "shingle").where((F.col("component_a") < F.col("component_b")) & enough), "met")
    met = met.join(one(posted, "a"), ["shingle", "component_a", "size_a", "place_a"]).join(one(posted, "b"), ["shingle", "component_b", "size_b", "place_b"])
    return materialize(met.select(F.col("key_a").alias("rep"), F.col("key_b").alias("other"), F.lit(1).alias("parts")).distinct(), "pairs")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, component) of every document: components of pairs whose sets of word shingles are so similar (Jaccard).

    SimHash fingerprints within a few bits are candidates, through the vantage-point tree; but pairs at 0.8 differ in
    ten bits at the median and up to eighteen, a radius at which no tree of 64-bit fingerprints prunes, so pairs that
    share a band of their MinHash signatures are candidates too: each document with the least and the largest key of
    its band. Texts with equal shingles are one before that. Signatures leave out pairs far below the threshold; a pair
    is a link only where its whole sets are so similar, and each is compared unless others link its documents already:
    first each document's likeliest pair, then those that are still open. Members of bands that hold several components
    then are joined exactly by their rarest shingles, so that no pair within a band is left out.

    Null, empty and blank texts have no shingles and are copies of each other; texts of fewer words have one shingle, all
    of them. Very long texts are compared whole. Rows that share a key are one document to this function. An empty table
    gives no rows; columns other than doc_id and text are ignored. key is row_key's; component is the least key.
    """
    own = materialize(_sketches(docs, words), "sketches")
    one = materialize(own.groupBy("same").agg(F.min("key").alias("rep"), F.any_value("fp").alias("fp"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")), "distinct")
    banded = one.select("rep", F.posexplode("bands").alias("n", "band"))
    ends = banded.groupBy("n", "band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high")
    ends = materialize(ends, "bands")
    parts = lambda members: F.ceil(members / HUB).cast("int").alias("parts")
    shared = materialize(likely_among(banded, ["n", "band"], ends).join(ends, ["n", "band"]), "shared")
    in_bands = shared.select("rep", F.explode(F.array("low", "high")).alias("other"), parts(F.col("members")))
    least = one.groupBy("fp").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("members"))
    tree = links(least.select("fp"), RADIUS)
    close = tree.join(least.select(F.col("fp").alias("a"), F.col("rep")), "a").join(least.select(F.col("fp").alias("b"), F.col("rep").alias("other")), "b")
    same_fp = one.join(least.select("fp", F.col("rep").alias("other"), "members"), "fp").select("rep", "other", parts(F.col("members")))
    both = in_bands.unionByName(same_fp).unionByName(close.select("rep", "other", F.lit(1).alias("parts"))).where("rep != other")
    pairs = both.groupBy("rep", "other").agg(F.max("parts").alias("parts"))
    rated = materialize(_compared(materialize(pairs, "candidates"), one.select(F.col("rep").alias("key"), F.col("sig").alias("own")), estimate, LOW), "rated")
    sets = _sets(docs, _keys(rated), words)
    exact = lambda found, sets: materialize(_compared(found, sets, jaccard, similarity).select(F.col("rep").alias("a"), F.col("other").alias("b")), "exact")
    best = rated.groupBy("rep").agg(F.max(F.struct("like", "other", "parts")).alias("best")).select("rep", "best.other", "best.parts")
    likeliest = exact(materialize(best, "best"), sets)
    label = materialize(connected_components(likeliest), "first")
    of = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    open_ = rated.join(of("rep"), "rep", "left").join(of("other"), "other", "left")
    open_ = materialize(open_.where(F.coalesce("crep", "rep") != F.coalesce("cother", "other")).select("rep", "other", "parts"), "open")
    label = materialize(connected_components(likeliest.unionByName(exact(open_, sets))), "linked")
    rest = materialize(_uncovered(shared, label), "rest")
    if not rest.isEmpty():
        sets = _sets(docs, rest.select("key"), words)
        more = exact(_sharing_prefixes(rest, sets, similarity), sets)
        # a component that the first links made is one node here
        of = lambda side: rest.select(F.col("key").alias(side), F.col("component").alias(f"c{side}"))
        joined = materialize(connected_components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "joined")
        again = joined.select(F.col("node").alias("component"), F.col("component").alias("__to"))
        whole = one.select("rep").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
        label = whole.join(again, "component", "left").select(F.col("rep").alias("node"), F.coalesce("__to", "component").alias("component"))
    group = one.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("same", F.coalesce("component", "rep").alias("component"))
    return own.select("key", "same").join(group, "same").select("key", "component")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with the least key of their group of near duplicates, all columns, whatever their names.

    Of rows that share id and text one stays, any of them where their other columns differ. Where rows share an id but
    not their text, all but those of one text have the hash of their text for a key. Null and blank texts are one group;
    null ids are known by the hash of their text; very long texts are compared whole; an empty table gives none.
    """
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    key, count, low = free_names(docs, "__key", "__n", "__low")
    keyed = docs.withColumn(key, row_key(docs))
    asked = keyed.select(F.col(key).alias("doc_id"), "text")
    several = keyed.select(F.col(key).alias("key"), text.alias("text")).groupBy("key").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    several = materialize(several.where("low < high").select(F.col("key").alias(key), F.col("low").alias(low)), "several")
    if not several.isEmpty():
        keyed = keyed.join(several, key, "left").withColumn(key, F.when(text != F.col(low), text).otherwise(F.col(key))).drop(low)
        asked = keyed.select(F.col(key).alias("doc_id"), "text")
    groups = new_folder(docs.sparkSession, "groups")
    with scratch(docs.sparkSession):
        near_duplicates(asked, words, similarity).write.parquet(groups)
    found = docs.sparkSession.read.schema("key long, component long").parquet(groups)
    own = found.groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias(count), F.max(F.col("key") == F.col("component")).alias(low))
    odd = materialize(own.where(~F.col(low) | (F.col(count) > 1)), "odd")  # keys that go, or whose rows are several
    out = likely_among(keyed, [key], odd.select(key)).join(odd, key, "left").where(F.coalesce(F.col(low), F.lit(True)))
    once = likely_among(keyed, [key], odd.select(key), others=True).unionByName(out.where(F.col(count).isNull()).drop(count, low))
    if not odd.where(F.col(low)).isEmpty():
        once = once.unionByName(out.where(F.col(count) > 1).drop(count, low).dropDuplicates([key]))
    return once.drop(key)


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = clusters(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
