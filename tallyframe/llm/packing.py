"""Best-fit-decreasing packing of token pieces into sequences.

Best fit decreasing only looks at lengths, so the driver packs the histogram of
lengths (at most ``capacity`` numbers, whatever the size of the corpus) and the
tasks carry the result to the pieces. A segment tree over remaining capacities
finds the tightest open sequence in logarithmic time; sequences with equal
remaining room are handled together, which gives the same packing as one piece
at a time. Pieces of a length are numbered over all tasks by counts per task
and length, so nothing is gathered by length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import tokens, units
from tallyframe.session import stored


class RoomTree:
    """Counts of open sequences by remaining room, with a successor search."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest room >= need that an open sequence has."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, first sequence, pieces per sequence, offset) runs.

    Piece ``first number + j`` of that length goes to sequence ``first sequence +
    j // pieces`` at ``offset + j % pieces * length``, up to the next run.
    """
    tree, open_at, runs, sequences = RoomTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_at.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, number = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = sequences, -(-left // per)
                sequences += n
            else:
                first, n = open_at[room].pop()
                tree.add(room, -n)
                per = room // length
            filled = min(n, left // per)
            if filled:
                runs.append((length, number, first, per, capacity - room))
                put(room - per * length, first, filled)
                left, number = left - filled * per, number + filled * per
            if filled < n and left:  # fewer than fill one more
                runs.append((length, number, first + filled, per, capacity - room))
                put(room - left * length, first + filled, 1)
                left, filled = 0, filled + 1
            put(room, first + filled, n - filled)
    return runs


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, number): documents with their
    end id, cut where longer than ``capacity`` (the first piece is the shorter).
    ``number`` counts pieces of one length within a task."""

    def run(batches):
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for piece in units.slices(batch):
                ids, first = tokens.with_end(*tokens.encoder(path).encode(piece.column("text")), end_id)
                total = np.diff(first)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), n)
                k = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                head = (total - (n - 1) * capacity)[row]
                start = np.where(k == 0, 0, head + (k - 1) * capacity)
                length = np.where(k == 0, head, capacity)
                order = np.argsort(length, kind="stable")
                size = np.bincount(length, minlength=capacity + 1)
                number = np.empty(len(length), np.int64)
                number[order] = np.arange(len(order)) - (np.cumsum(size) - size)[length[order]]
                number += met[length]
                met += size
                at = first[:-1][row] + start
                raw = [ids[a : a + m].astype("<u4").tobytes() for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(row)), pa.array(k, pa.int32()), pa.array(start), pa.array(length),
                     pa.array(raw, pa.binary()), pa.array(np.full(len(row), part), pa.int32()), pa.array(number)],
                    ["doc_id", "piece", "start", "length", "ids", "part", "number"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, number bigint"
    )


def packed(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of
    ``docs`` (doc_id, text).

    A null or empty text is its end id alone. Repeated rows and null doc_ids are
    packed like any other. Which of several pieces of one length goes where is
    settled by their place in the input. An empty table has no pieces; other
    columns are ignored.
    """
    cut = stored(pieces(docs, path, end_id, capacity), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = stored(counts, "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(best_fit_runs(histogram, capacity)), np.int64).reshape(-1, 5)
    keys = runs[:, 0] << 48 | runs[:, 1]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            run = runs[np.searchsorted(keys, length << 48 | number, side="right") - 1]
            j = number - run[:, 1]
            sequence, offset = run[:, 2] + j // run[:, 3], run[:, 4] + j % run[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    numbered = cut.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids", (F.col("number") + F.col("base")).alias("number")
    )
    return numbered.mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"
    )
