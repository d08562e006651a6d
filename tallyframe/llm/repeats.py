"""Removal of long byte repeats by prefix-free parsing.

Parse. A rolling hash over ``GRAM`` bytes triggers phrase boundaries: in every
stretch of ``REACH`` starts the leftmost smallest hash is a trigger, so triggers
depend on the text beside them only and no stretch is without one. A window of
``length`` bytes is then (phrase suffix, parse suffix): the bytes before its
first trigger, and what follows the trigger. Equal windows have equal parts, so
the corpus order of all windows is the order by (parse suffix, phrase suffix),
and a window is repeated if it has an equal neighbour in that order. Only
equality to a depth of ``length`` bytes matters, so the two suffix orders are
kept as groups of equal hashes in Spark tables, not as one array in one place.

Dictionary. One entry for each trigger and the starts that it is first for:
``full``, all bytes that these windows cover, and ``core``, the bytes that all
of them share. Entries are counted with a partial count before the shuffle, so
text that repeats very often costs one row for each task.

- ``full`` seen twice: every window of the entry is repeated;
- ``core`` seen once: none is;
- else the entry lies at the edge of a repeat. Its windows, one for each phrase
  suffix, are looked up singly, against the other edges and one example of each
  repeated entry with that core.

Rows are known by a 64-bit hash of (doc_id, text); equal rows share it and get
equal results. Hashes have 64 bits; byte strings are not compared again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import units
from tallyframe.session import stored

GRAM = 16
_PIECE = 1 << 20


def entries(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, trigger) of each dictionary entry of the batch."""
    n = len(data)
    none = np.zeros(0, np.int64)
    reach = 1 << ((length - GRAM) // 2).bit_length() - 1
    if n < length:
        return none, none, none
    at = np.arange(n - GRAM + 1)
    low = units.ranges(sums, at, at + GRAM) >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)
    width = 1
    while width < reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    start = np.concatenate(
        [none, *(np.arange(a, b - length + 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b - a >= length)]
    )
    if not len(start):
        return none, none, none
    trigger = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last], trigger[first]


def _dictionary(rows: DataFrame, length: int) -> DataFrame:
    """(core, full, row, place): place is the first start * 2**16 + the number of starts."""
    reach = 1 << ((length - GRAM) // 2).bit_length() - 1

    def run(batches):
        for batch in batches:
            for part in units.slices(batch, limit=_PIECE):
                data, offsets = units.column_bytes(part.column("text"))
                sums = units.running(data)
                first, last, trigger = entries(data, offsets, sums, length)
                row = np.searchsorted(offsets, first, side="right") - 1
                full = units.ranges(sums, first, last + length) ^ units.mix((trigger - first).astype(np.uint64))
                core = units.ranges(sums, trigger, trigger + length - reach + 1)
                place = (first - offsets[row]) << 16 | (last - first + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(full.view(np.int64)),
                     part.column("row").take(pa.array(row)), pa.array(place)], ["core", "full", "row", "place"])

    return rows.select("row", "text").mapInArrow(run, "core bigint, full bigint, row bigint, place bigint")


def _windows(affected: DataFrame, length: int, kinds: tuple[int, ...]) -> DataFrame:
    """(window, row, start) of every window of the entries of these kinds."""

    def run(batches):
        for batch in batches:
            for part in units.slices(batch, limit=_PIECE):
                data, offsets = units.column_bytes(part.column("text"))
                sums = units.running(data)
                marks = part.column("marks")
                n = np.diff(marks.offsets.to_numpy())
                flat = marks.flatten()
                place = flat.field("place").to_numpy(zero_copy_only=False)
                kind = flat.field("kind").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), n)
                use = np.isin(kind, kinds)
                place, row = place[use], row[use]
                count = place & 0xFFFF
                which = np.repeat(np.arange(len(place)), count)
                start = (place >> 16)[which] + np.arange(len(which)) - (np.cumsum(count) - count)[which]
                row = row[which]
                at = start + offsets[row]
                window = units.ranges(sums, at, at + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window.view(np.int64)), part.column("row").take(pa.array(row)), pa.array(start)],
                    ["window", "row", "start"])

    return affected.mapInArrow(run, "window bigint, row bigint, start bigint")


def _cut(found: DataFrame, length: int) -> DataFrame:
    """(row, n_removed, spans, kept_text) from texts with their repeated starts."""

    def run(batches):
        for batch in batches:
            for part in units.slices(batch, limit=_PIECE):
                data, offsets = units.column_bytes(part.column("text"))
                marks, single = part.column("marks").to_pylist(), part.column("starts").to_pylist()
                removed, spans, kept = [], [], []
                for i in range(part.num_rows):
                    text = data[offsets[i] : offsets[i + 1]]
                    change = np.zeros(len(text) + 1, np.int64)
                    whole = np.array([m["place"] for m in marks[i] if m["kind"]], np.int64)
                    lone = np.array(single[i] or [], np.int64)
                    np.add.at(change, np.concatenate([whole >> 16, lone]), 1)
                    np.add.at(change, np.concatenate([(whole >> 16) + (whole & 0xFFFF) - 1, lone]) + length, -1)
                    gone = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
                    edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
                    removed.append(int((edges[:, 1] - edges[:, 0]).sum()))
                    spans.append([{"s": s, "e": e} for s, e in edges.tolist()])
                    kept.append(text[~gone[1:-1]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.binary())],
                    ["row", "n_removed", "spans", "kept_bytes"])

    return found.mapInArrow(run, "row bigint, n_removed bigint, spans array<struct<s:bigint,e:bigint>>, kept_bytes binary")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(row, n_removed, spans, kept_bytes) of the rows of ``docs`` that have a
    byte string of ``length`` bytes which also starts anywhere else in the corpus;
    one row for all copies of an id and text.

    ``row`` is xxhash64(doc_id, text). Spans are maximal runs of removed bytes,
    ends exclusive. Matches never cross rows, may overlap, and are judged on the
    input. Null and empty texts and texts shorter than ``length`` have none.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").where(F.octet_length("text") >= length)
    dictionary = _dictionary(rows, length)
    counted = dictionary.groupBy("core", "full").agg(F.count("*").alias("n"))
    counted = stored(counted, "entries")
    cores = counted.groupBy("core").agg(
        F.sum("n").alias("total"), F.max(F.col("n") == 1).alias("mixed")
    ).where("total > 1")
    known = stored(
        counted.join(cores, "core").select("core", "full", (F.col("n") > 1).alias("whole"), "mixed"), "known"
    )
    marks = dictionary.select("full", "row", "place").join(known, "full")
    # kinds: 0 edge, 1 repeated as a whole, 2 also the example that edges are held against
    marks = stored(marks, "marks")
    examples = marks.where("whole and mixed").groupBy("full").agg(F.min(F.struct("row", "place")).alias("m"))
    kinds = marks.select("row", "place", F.col("whole").cast("int").alias("kind")).union(
        examples.select("m.row", "m.place", F.lit(2))
    )
    # Copies of a row share its marks and one of them stands for all: its entries
    # are repeated already, so only lone edges are still to be looked up.
    by_row = kinds.groupBy("row").agg(F.collect_set(F.struct("place", "kind")).alias("marks"))
    one_each = by_row.join(rows, "row").select("row", "text", "marks").dropDuplicates(["row"])
    affected = stored(one_each, "affected")
    again = (
        _windows(affected, length, (0, 2)).select("window").groupBy("window")
        .agg(F.count("*").alias("n")).where("n > 1").select("window")
    )
    starts = (
        _windows(affected, length, (0,)).join(again, "window", "left_semi")
        .groupBy("row").agg(F.collect_list("start").alias("starts"))
    )
    found = affected.join(starts, "row", "left").select("row", "text", "marks", "starts")
    return _cut(found, length).where("n_removed > 0")


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of
    ``docs`` (doc_id, text); a null text is empty, rows with equal id and text
    repeat each other. Other columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("whole_sha256"),
    )
    cut = repeated_spans(docs, length).select(
        "row", "n_removed", "spans", F.sha2("kept_bytes", 256).alias("cut_sha256")
    )
    zero = F.lit(0).cast("bigint")
    return base.join(cut, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce(F.size("spans").cast("bigint"), zero).alias("n_spans"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"),
    )
