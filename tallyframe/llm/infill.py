"""Fill-in-the-middle examples, cut at places found by memoized chunks.

A text is cut into chunks where a rolling hash of its bytes says so, hence a
passage that many documents share falls into the same chunks in all of them.
What a chunk adds to a text is a small summary: its units (code points that
begin in it), whether it holds a control string, and its first and last bytes,
as a control string may lie across a border. Summaries are kept by the hash of
the chunk and used again only if the bytes are equal. They combine from left to
right, so a document's units are a sum over its chunks, and a cut at unit k is
found by the running sum and one look into one chunk.

The memo belongs to the Python worker and is bounded in bytes: losing it costs
a count, never a result. Nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import units

WINDOW = 16  # bytes that the rolling hash sees


@dataclass(frozen=True)
class Params:
    seed: int = 1
    formed: int = 90  # of 100 texts; the others stay as they are
    suffix_first: int = 20  # of 100 formed texts
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    mean_chunk: int = 1024  # bytes, a power of two
    least_chunk: int = 128
    most_chunk: int = 8192
    memo_bytes: int = 32 << 20

    @property
    def marks(self) -> tuple[bytes, ...]:
        return tuple(m.encode() for m in (self.prefix_mark, self.suffix_mark, self.middle_mark))


@dataclass(frozen=True)
class Summary:
    """What a run of bytes adds to a text. ``head`` and ``tail`` are its first
    and last bytes, one less than the longest control string."""

    units: int = 0
    marked: bool = False
    head: bytes = b""
    tail: bytes = b""


def summary(chunk: bytes, marks: tuple[bytes, ...]) -> Summary:
    edge = max(map(len, marks)) - 1
    raw = np.frombuffer(chunk, np.uint8)
    return Summary(int(np.count_nonzero((raw & 0xC0) != 0x80)), any(m in chunk for m in marks), chunk[:edge], chunk[-edge:])


def combined(a: Summary, b: Summary, marks: tuple[bytes, ...]) -> Summary:
    """The summary of a's bytes followed by b's."""
    edge = max(map(len, marks)) - 1
    seam = a.tail + b.head
    return Summary(a.units + b.units, a.marked or b.marked or any(m in seam for m in marks),
                   (a.head + b.head)[:edge] if len(a.head) < edge else a.head,
                   (a.tail + b.tail)[-edge:] if len(b.tail) < edge else b.tail)


class Memo:
    """Summaries by chunk hash, verified by content, in two generations: the
    older one goes when the younger one is full."""

    def __init__(self, p: Params):
        self.marks, self.room = p.marks, p.memo_bytes // 2
        self.young: dict[int, tuple[bytes, Summary]] = {}
        self.old: dict[int, tuple[bytes, Summary]] = {}
        self.used = self.hits = 0

    def get(self, key: int, chunk: bytes) -> Summary:
        entry = self.young.get(key)
        if entry is None:
            entry = self.old.get(key)
            if entry is None or entry[0] != chunk:
                entry = (chunk, summary(chunk, self.marks))
            else:
                self.hits += 1
            self.used += len(chunk) + 200
            if self.used > self.room:
                self.old, self.young, self.used = self.young, {}, len(chunk) + 200
            self.young[key] = entry
        elif entry[0] == chunk:
            self.hits += 1
        else:  # another chunk with this hash
            return summary(chunk, self.marks)
        return entry[1]


@lru_cache(maxsize=2)
def memo(p: Params) -> Memo:
    return Memo(p)


def borders(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, p: Params) -> tuple[list[int], list[int]]:
    """(chunk borders, number of chunks before each row): every row is a run of
    chunks, cut between code points; an empty row has none."""
    n = len(data)
    # A border at i where the WINDOW bytes before it hash to zero bits, if i begins a code point.
    starts = np.arange(max(n - WINDOW, 0))
    called = units.ranges(sums, starts, starts + WINDOW) & np.uint64(p.mean_chunk - 1)
    places = starts[called == 0] + WINDOW
    places = places[(data[places] & 0xC0) != 0x80].tolist() if len(places) else []
    cuts, first = [0], [0]
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        at = a
        while at < z:
            far = min(at + p.most_chunk, z)
            # No chunk is shorter than a window, so none that counts began in the row before.
            k = bisect_right(places, at + max(p.least_chunk, WINDOW) - 1)
            at = min(places[k], far) if k < len(places) else far
            while at < z and data[at] & 0xC0 == 0x80:
                at -= 1
            cuts.append(at)
        first.append(len(cuts) - 1)
    return cuts, first


def _place(chunk: bytes, unit: int) -> int:
    """The byte at which the unit-th code point of the chunk begins."""
    raw = np.frombuffer(chunk, np.uint8)
    return int(np.flatnonzero((raw & 0xC0) != 0x80)[unit])


def _formed(raw: bytes, cuts: list[int], parts: list[Summary], h: tuple[int, ...], p: Params):
    """(units, form, prefix units, middle units, output) of one text."""
    whole, counted = Summary(), [0]
    for s in parts:
        whole = combined(whole, s, p.marks)
        counted.append(whole.units)
    n = whole.units
    if not n or whole.marked or h[2] % 100 >= p.formed:
        return n, "plain", None, None, raw
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    at = []
    for unit in (low, high):
        k = bisect_right(counted, unit) - 1  # the chunk that holds the unit
        at.append(len(raw) if unit == n else cuts[k] + _place(raw[cuts[k] : cuts[k + 1]], unit - counted[k]))
    prefix, middle, suffix = raw[: at[0]], raw[at[0] : at[1]], raw[at[1] :]
    pre, suf, mid = p.marks
    if h[3] % 100 < p.suffix_first:
        return n, "spm", low, high - low, b"".join((suf, suffix, pre, prefix, mid, middle))
    return n, "psm", low, high - low, b"".join((pre, prefix, suf, suffix, mid, middle))


def infilled(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of
    ``docs`` (doc_id, text).

    Draws come from the hex sha256 of ``seed:doc_id``. A null text is empty, and
    an empty text, one that holds a control string and those that the third draw
    leaves out are ``plain``: output is the text, lengths are null. A null
    doc_id draws as an empty one; repeated rows give equal rows, one each. Other
    columns are ignored, an empty table gives none.
    """
    digest = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]

    def run(batches):
        known = memo(p)
        for batch in batches:
            for piece in units.slices(batch):
                data, offsets = units.column_bytes(piece.column("text"))
                sums = units.running(data)
                cuts, first = borders(data, offsets, sums, p)
                ends = np.array(cuts, np.int64)
                keys = units.ranges(sums, ends[:-1], ends[1:]).tolist()
                h = zip(*(piece.column(f"h{i}").to_pylist() for i in range(1, 5)), strict=True)
                out = []
                for i, drawn in enumerate(h):
                    a, lo, hi = int(offsets[i]), first[i], first[i + 1]
                    raw = data[a : int(offsets[i + 1])].tobytes()
                    own = [c - a for c in cuts[lo : hi + 1]]
                    parts = [known.get(keys[lo + j], raw[own[j] : own[j + 1]]) for j in range(hi - lo)]
                    out.append(_formed(raw, own, parts, drawn, p))
                n, form, prefix, middle, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(text, pa.binary()).view(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *draws).mapInArrow(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column, p: Params = Params()) -> Column:
    """The text that ``infilled`` made an output of. A formed text holds no
    control string, so the first ones found are the ones that were put in."""

    def between(first: str, last: str | None) -> Column:
        upto = F.substring_index(output, last, 1) if last else output
        return F.substring_index(upto, first, -1)

    middle = between(p.middle_mark, None)
    psm = F.concat(between(p.prefix_mark, p.suffix_mark), middle, between(p.suffix_mark, p.middle_mark))
    spm = F.concat(between(p.prefix_mark, p.middle_mark), middle, between(p.suffix_mark, p.prefix_mark))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
