"""Near duplicates by circulant MinHash, banding and exact Jaccard.

A signature coordinate k of a set is min over its shingles of pi[sigma(s) + k]:
one permutation places a shingle in the universe, the second one, shifted
circularly by k, ranks it. The K values of one shingle are therefore neighbours
in one array, and a signature is the column-wise minimum of array slices.

From signatures to groups, without all pairs of a bucket:

1. rows with equal shingle sets are one class (a 128-bit key of the sorted set);
2. classes that share a band are candidates; only their sets are built again;
3. a shingle that only one candidate has cannot be shared: classes and pairs
   whose other shingles are too few for the threshold are dropped, without loss;
4. every member of a bucket is compared with the bucket's most central class,
   on whole sets, and verified pairs are joined to components;
5. pairs of a bucket that are still in different components are compared as
   well, after step 3 was repeated with shingles that only one component has.
   So every candidate pair is either compared, or connected already, or cannot
   reach the threshold.

With 24 bands of 4 rows a pair at similarity 0.85 shares no band with
probability (1 - 0.85**4)**24 = 2e-8.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tallyframe.llm import units
from tallyframe.llm.components import components
from tallyframe.session import stored


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 85  # 100 * intersection >= percent * union
    bands: int = 24
    rows: int = 4
    universe_bits: int = 20
    seed: int = 11
    prunings: int = 2  # rounds of step 5


@lru_cache(maxsize=2)
def _permutations(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(sigma, all circular windows of pi)."""
    size, k = 1 << p.universe_bits, p.bands * p.rows
    rng = np.random.default_rng(p.seed)
    sigma, pi = rng.permutation(size), rng.permutation(size).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)


def signature(shingle_set: np.ndarray, p: Params) -> np.ndarray:
    """The bands * rows coordinates of a set that is not empty."""
    sigma, shifted = _permutations(p)
    at = sigma[shingle_set & np.uint64((1 << p.universe_bits) - 1)]
    low = shifted[at[:4096]].min(axis=0)
    for i in range(4096, len(at), 4096):
        low = np.minimum(low, shifted[at[i : i + 4096]].min(axis=0))
    return low


def band_keys(sig: np.ndarray, p: Params) -> np.ndarray:
    """One 64-bit key per band; equal rows of one band give equal keys."""
    parts = sig.reshape(p.bands, p.rows).astype(np.uint64)
    key = np.arange(1, p.bands + 1, dtype=np.uint64)
    for j in range(p.rows):
        key = units.mix(key * np.uint64(units.BASE) + parts[:, j])
    return key.view(np.int64)


def _sets(batch: pa.RecordBatch, width: int):
    """(row, sorted distinct shingle hashes) of the batch."""
    data, offsets = units.column_bytes(batch.column("text"))
    data = units.LOWER[data]
    starts, ends, first = units.words(data, offsets, units.NO_SPACE)
    hashes = units.ranges(units.running(data), starts, ends)
    runs, begin = units.shingles(hashes, first, width)
    for i in range(batch.num_rows):
        yield i, np.unique(runs[begin[i] : begin[i + 1]])


def _key(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, text_key) of every row; no key and no
    bands where the text is null or has no word. doc_id may be of any type."""

    def run(batches):
        for batch in batches:
            for part in units.slices(batch):
                sizes, keys, bands = [], [], []
                for _, s in _sets(part, p.words):
                    sizes.append(len(s))
                    keys.append(_key(s) if len(s) else None)
                    bands.append(band_keys(signature(s, p), p) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), part.column("text_key")],
                    ["doc_id", "n_shingles", "set_key", "bands", "text_key"],
                )

    kept = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    more = StructType.fromDDL("n_shingles bigint, set_key binary, bands array<bigint>, text_key bigint")
    return kept.mapInArrow(run, StructType([kept.schema["doc_id"], *more]))


def _rebuilt(wanted: DataFrame, width: int) -> DataFrame:
    """(cid, shingles) of (cid, set_key, text) rows whose text has that set."""

    def run(batches):
        for batch in batches:
            for part in units.slices(batch):
                cids, keys = part.column("cid").to_pylist(), part.column("set_key").to_pylist()
                found = [(cids[i], s.tobytes()) for i, s in _sets(part, width) if _key(s) == keys[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())],
                    ["cid", "shingles"],
                )

    return wanted.select("cid", "set_key", "text").mapInArrow(run, "cid bigint, shingles binary")


def _exploded(sets: DataFrame, *keep: str) -> DataFrame:
    """One row per shingle, with the columns ``keep``."""

    def run(batches):
        for batch in batches:
            for part in units.slices(batch, "shingles", 1 << 20):
                data, offsets = units.column_bytes(part.column("shingles"))
                row = pa.array(np.repeat(np.arange(part.num_rows), np.diff(offsets) // 8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(data.tobytes(), np.int64))] + [part.column(c).take(row) for c in keep],
                    ["shingle", *keep],
                )

    kinds = dict(sets.dtypes)
    return sets.select("shingles", *keep).mapInArrow(
        run, ", ".join(["shingle bigint", *(f"{c} {kinds[c]}" for c in keep)])
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("set_a")[i].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column("set_b")[i].as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, k in zip(a, ok, strict=True) if k], pa.int64()),
                 pa.array([v for v, k in zip(b, ok, strict=True) if k], pa.int64())], ["a", "b"])

    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint")


def _reachable(a: str, b: str, percent: int):
    """Whether common = min(common_a, common_b) could reach the threshold:
    100 * common >= percent * (n_a + n_b - common)."""
    low = F.least(F.col(f"{a}_common"), F.col(f"{b}_common"))
    return (100 + percent) * low >= percent * (F.col(f"{a}_n") + F.col(f"{b}_n"))


def _shared_buckets(members: DataFrame, *distinct_by: str) -> DataFrame:
    """The rows of buckets in which the given column has two values at least."""
    of = distinct_by[0] if distinct_by else "cid"
    spread = members.groupBy("bucket").agg(F.min(of).alias("lo"), F.max(of).alias("hi"))
    return members.join(spread.where("lo <> hi").select("bucket"), "bucket")


def class_links(classes: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """(node, comp) over the class ids that have a link."""
    buckets = classes.select("cid", F.explode("bands").alias("bucket"))
    members = stored(_shared_buckets(buckets), "members")
    wanted = members.select("cid").distinct().join(classes.drop("bands"), "cid")
    # One text for each class, by id and text: null ids meet by their text alone.
    def named(of: str):
        return F.coalesce(of, F.lit(-1)) if isinstance(docs.schema["doc_id"].dataType, LongType) else F.col(of)

    texts = docs.select(named("doc_id").alias("rep_id"), F.xxhash64("text").alias("text_key"), "text").join(
        wanted.select("cid", "set_key", named("rep").alias("rep_id"), "text_key"), ["rep_id", "text_key"]
    )
    sets = stored(_rebuilt(texts, p.words).dropDuplicates(["cid"]), "sets")

    alone = (
        _exploded(sets, "cid").groupBy("shingle").agg(F.count("*").alias("df"), F.min("cid").alias("cid"))
        .where("df = 1").groupBy("cid").agg(F.count("*").alias("own"))
    )
    sized = wanted.select("cid", "n").join(alone, "cid", "left").select(
        "cid", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")
    )
    able = stored(sized.where(F.col("common") * 100 >= F.col("n") * p.percent), "able")
    members = stored(_shared_buckets(members.join(able, "cid")), "members")
    hubs = members.groupBy("bucket").agg(F.min(F.struct((F.col("n") - F.col("common")).alias("own"), "cid", "n", "common")).alias("hub"))
    pairs = members.join(hubs, "bucket").where("cid <> hub.cid").select(
        F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b"),
        F.col("n").alias("m_n"), F.col("common").alias("m_common"),
        F.col("hub.n").alias("h_n"), F.col("hub.common").alias("h_common"),
    ).where(_reachable("m", "h", p.percent)).select("a", "b").distinct()
    pairs = stored(pairs, "pairs")
    links = stored(_verified(pairs, sets, p.percent), "links")
    labels = components(links)

    grouped = members.join(labels, members.cid == labels.node, "left").select(
        "bucket", "cid", "n", F.coalesce("comp", "cid").alias("comp"), F.col("n").alias("common")
    )
    grouped = stored(_shared_buckets(grouped, "comp"), "grouped")
    if not grouped.limit(1).count():
        return labels
    for _ in range(p.prunings):
        grouped = stored(_prunable(grouped, sets, p), "open")
    # A pair that shares several buckets is met in the lowest of them only.
    sides = grouped.join(classes.select("cid", "bands"), "cid")
    x, y = (
        sides.select("bucket", *(F.col(c).alias(f"{side}_{c}") for c in ("cid", "n", "comp", "common", "bands")))
        for side in ("x", "y")
    )
    met_first = F.array_min(F.array_intersect("x_bands", "y_bands")) == x["bucket"]
    rest = (
        x.join(y, (x["bucket"] == y["bucket"]) & (F.col("x_comp") != F.col("y_comp")) & (F.col("x_cid") < F.col("y_cid"))
               & _reachable("x", "y", p.percent) & met_first)
        .select(F.col("x_cid").alias("a"), F.col("y_cid").alias("b"))
        .join(pairs, ["a", "b"], "left_anti")
    )
    more = stored(_verified(stored(rest, "rest"), sets, p.percent), "links")
    return components(links.union(more)) if more.limit(1).count() else labels


def _prunable(grouped: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The rows (bucket, cid, n, comp, common) of ``grouped`` that can still be
    linked to another component: ``common`` counts the shingles of a class that
    some other component of these rows has, too."""
    open_sets = sets.join(grouped.select("cid", "comp").distinct(), "cid")
    inner = (
        _exploded(open_sets, "cid", "comp").groupBy("shingle")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("df"),
             F.min("cid").alias("cid"), F.max("cid").alias("cid2"))
        .where("lo = hi")
    )
    # Most shingles of one component have one or two classes; others are joined back.
    few = inner.where("df <= 2").select(F.explode(F.array_distinct(F.array("cid", "cid2"))).alias("cid"))
    many = _exploded(open_sets, "cid").join(inner.where("df > 2").select("shingle"), "shingle").select("cid")
    own = few.union(many).groupBy("cid").agg(F.count("*").alias("own"))
    left = grouped.select("bucket", "cid", "n", "comp").join(own, "cid", "left").select(
        "bucket", "cid", "n", "comp", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")
    ).where(F.col("common") * 100 >= F.col("n") * p.percent)
    return _shared_buckets(left, "comp")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Null or wordless text: an empty set, linked with nothing, its own component.
    Rows with equal texts are one class. A row that repeats a doc_id is one more
    row with that id. A null doc_id takes part by its text, counts as no
    smallest id, and is kept only if its component has no id at all. An empty
    table gives an empty result; other columns are ignored.
    """
    sketch = stored(sketches(docs, p), "sketch")
    classes = (
        sketch.where("set_key is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"),
             F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("text_key", F.col("first.text_key")).drop("first")
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = stored(classes, "classes")
    labels = class_links(classes, docs, p)
    placed = classes.join(labels, classes.cid == labels.node, "left").select(
        "set_key", "rep", F.coalesce("comp", "cid").alias("comp")
    )
    linked = placed.join(labels.select("comp").distinct(), "comp")
    lowest = linked.groupBy("comp").agg(F.min("rep").alias("low"))
    group = linked.join(lowest, "comp").select("set_key", "low").union(
        placed.join(labels.select("comp").distinct(), "comp", "left_anti").select("set_key", "rep")
    )
    return sketch.drop("bands", "text_key").join(group, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that stay: exactly one row of each group.

    Rows are known by their doc_id and a 128-bit hash of all their columns, so null
    and repeated doc_ids are rows like all others, and the key of a row is the
    same on every read: no text is stored. Of a group the row with the smallest
    doc_id stays, nulls last, then the one with the smallest hash; of equal rows
    one. Rows without words are in no group.
    """
    keyed = docs.select(
        F.struct("*").alias("row"),
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.unhex(F.md5(F.to_json(F.struct("*")))).alias("hash")).alias("key"),
    )
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), p)
    first = found.where("kept").groupBy(F.col("doc_id").alias("key")).agg(
        ((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("copied")
    )
    first = stored(first, "first")
    kept = keyed.join(first.where("not copied"), "key", "left_semi").select("row")
    # Equal rows cannot be told apart: one of each is picked.
    copied = keyed.join(first.where("copied"), "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return kept.unionByName(copied).select("row.*")
