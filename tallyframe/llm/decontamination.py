"""Benchmark contamination by suffix arrays over the training words.

The training text is indexed shard by shard: a shard is a run of whole rows of
one task, and its suffix array holds word positions in lexicographic order of
the words that follow. Every benchmark window (a test suffix cut at its width)
is then found by one binary search per shard, all windows at a time. Only
suffixes that can hold a whole window are entered: a suffix that meets a word
which no benchmark text has, before its shortest possible window ends, matches
none. A row lies in one shard, so nothing is shuffled.

The benchmark is cut into blocks of ``block_bytes`` of text; one block at a time
is sent to the tasks, and with more than one block the state goes through the
shared folder in between. So what is broadcast never outgrows the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyframe.llm import units
from tallyframe.session import stored

BLOCK_BYTES = 8 << 20
_STATE = (
    "doc_id bigint, text string, n_words bigint, runs array<struct<s:bigint,e:bigint>>, items array<bigint>, "
    "matches array<struct<item_id:bigint,words:bigint,doc_word:bigint,item_word:bigint>>"
)


@dataclass(frozen=True)
class Index:
    """The windows of one block. Word codes run from 1; 0 pads."""

    width: int
    vocabulary: np.ndarray  # sorted word hashes; the code is the place + 1
    low: np.ndarray  # distinct windows, packed, padded with 0
    high: np.ndarray  # the same, padded with the largest code
    size: np.ndarray  # words of each distinct window
    need: np.ndarray  # by code: the fewest words of a window that starts so
    use_of: np.ndarray  # uses of the windows, ordered by window: where each begins
    use_item: np.ndarray  # item number of each use
    use_word: np.ndarray  # first word of each use in its item
    item_ids: list


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = units.column_bytes(texts)
    data = units.LOWER[data]
    starts, ends, first = units.words(data, offsets, units.LETTERS)
    return units.ranges(units.running(data), starts, ends), first


def _packed(codes: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Two codes per 64-bit column, beginning at ``at``; ``pad`` past ``size``."""
    padded = np.concatenate([codes, np.zeros(width + 1, np.uint64)])
    columns = []
    for j in range(0, width, 2):
        a = np.where(j < size, padded[at + j], np.uint64(pad))
        b = np.where(j + 1 < size, padded[at + j + 1], np.uint64(pad))
        columns.append(a << np.uint64(32) | b)
    return np.stack(columns) if columns else np.zeros((0, len(at)), np.uint64)


def build_index(item_ids: list, texts: list, width: int) -> Index:
    hashes, first = _word_hashes(pa.array(texts, pa.string()))
    vocabulary, codes = np.unique(hashes, return_inverse=True)
    codes = codes.astype(np.uint64) + np.uint64(1)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    item = np.repeat(np.arange(len(n)), count)
    begin = np.cumsum(count) - count
    word = np.arange(int(count.sum())) - begin[item]
    at, size = first[:-1][item] + word, np.minimum(n, width)[item]
    low = _packed(codes, at, size, width, 0)
    order = np.lexsort(low[::-1]) if len(at) else np.zeros(0, np.int64)
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = (low[:, order[1:]] != low[:, order[:-1]]).any(axis=0)
    picked = order[fresh]
    need = np.full(len(vocabulary) + 1, 1 << 40)
    np.minimum.at(need, codes[at].astype(np.int64), size)
    return Index(
        width, vocabulary, low[:, picked], _packed(codes, at[picked], size[picked], width, (1 << 32) - 1),
        size[picked], need, np.append(np.flatnonzero(fresh), len(order)), item[order], word[order], list(item_ids),
    )


def _first_not_below(keys: np.ndarray, patterns: np.ndarray, strictly: bool) -> np.ndarray:
    """For each pattern the first of the sorted keys that is >= it (> if strictly)."""
    lo, hi = np.zeros(patterns.shape[1], np.int64), np.full(patterns.shape[1], keys.shape[1], np.int64)
    while (lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, keys.shape[1] - 1)
        below, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for key, pattern in zip(keys, patterns, strict=True):
            k = key[mid]
            below |= same & (k < pattern)
            same &= k == pattern
        if strictly:
            below |= same
        active = lo < hi
        lo = np.where(active & below, mid + 1, lo)
        hi = np.where(active & ~below, mid, hi)
    return lo


def suffix_array(codes: np.ndarray, stop: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions ``at`` in the order of their next ``width`` words, their packed words)."""
    keys = _packed(codes, at, np.minimum(stop[at] - at, width), width, 0)
    order = np.lexsort(keys[::-1])
    return at[order], keys[:, order]


def _occurrences(index: Index, codes: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window number, word position) of every window found in the shard."""
    n = len(codes)
    gaps = np.append(np.flatnonzero(codes == 0), n)
    stop = np.minimum(gaps[np.searchsorted(gaps, np.arange(n))], row_end)
    at = np.flatnonzero(stop - np.arange(n) >= index.need[codes.astype(np.int64)])
    none = np.zeros(0, np.int64)
    if not len(at) or not len(index.size):
        return none, none
    places, keys = suffix_array(codes, stop, at, index.width)
    lo, hi = _first_not_below(keys, index.low, False), _first_not_below(keys, index.high, True)
    found = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(found)), found)
    return window, places[lo[window] + np.arange(len(window)) - (np.cumsum(found) - found)[window]]


def _longest(index: Index, window: np.ndarray, at: np.ndarray, row: np.ndarray, first: np.ndarray) -> dict:
    """(row, item) -> (words, word in the row, word in the item), the first longest."""
    if not len(window):
        return {}
    uses = np.diff(index.use_of)[window]
    which = np.repeat(np.arange(len(window)), uses)
    use = index.use_of[window][which] + np.arange(len(which)) - (np.cumsum(uses) - uses)[which]
    item, word, pos, size = index.use_item[use], index.use_word[use], at[which], index.size[window[which]]
    order = np.lexsort((pos, pos - word, item, row[pos]))
    item, word, pos, size = item[order], word[order], pos[order], size[order]
    doc = row[pos]
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(pos) != 1) | (np.diff(word) != 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(pos)) - 1
    best: dict = {}
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        key = (int(doc[b]), int(item[b]))
        length = int(pos[e] - pos[b] + size[e])
        if key not in best or length > best[key][0]:
            best[key] = (length, int(pos[b] - first[doc[b]]), int(word[b]))
    return best


def _search(index: Index, part: pa.RecordBatch) -> pa.RecordBatch:
    hashes, first = _word_hashes(part.column("text"))
    n, rows = len(hashes), part.num_rows
    row = np.repeat(np.arange(rows), np.diff(first))
    codes = np.zeros(n, np.uint64)
    if len(index.vocabulary) and n:
        place = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
        codes = np.where(index.vocabulary[place] == hashes, place + 1, 0).astype(np.uint64)
    window, at = _occurrences(index, codes, first[1:][row])
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + index.size[window], -1)
    hit = np.cumsum(change[:-1]) > 0
    old_runs, old_items, old_matches = (part.column(c).to_pylist() for c in ("runs", "items", "matches"))
    for i, before in enumerate(old_runs):
        for r in before:
            hit[first[i] + r["s"] : first[i] + r["e"]] = True
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    starts = np.flatnonzero(hit & (~np.append(False, hit[:-1]) | edge[:-1]))
    ends = np.flatnonzero(hit & (~np.append(hit[1:], False) | edge[1:])) + 1
    runs: list = [[] for _ in range(rows)]
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        runs[row[s]].append({"s": s - int(first[row[s]]), "e": e - int(first[row[s]])})
    items = [set(x) for x in old_items]
    for (i, item), (words, doc_word, item_word) in _longest(index, window, at, row, first).items():
        name = index.item_ids[item]
        if name is not None:
            items[i].add(name)
        old_matches[i].append({"item_id": name, "words": words, "doc_word": doc_word, "item_word": item_word})
    schema = part.schema
    fresh = {
        "n_words": pa.array(np.diff(first), pa.int64()), "runs": pa.array(runs, schema.field("runs").type),
        "items": pa.array([sorted(x) for x in items], schema.field("items").type),
        "matches": pa.array(old_matches, schema.field("matches").type),
    }
    return pa.RecordBatch.from_arrays([fresh.get(n, part.column(n)) for n in schema.names], schema=schema)


def _blocks(bench: DataFrame, limit: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of the benchmark, at most ``limit`` bytes or one item each."""
    ids, texts, size = [], [], 0
    for r in bench.select("item_id", "text").where("text is not null").toLocalIterator():
        more = len(r["text"].encode())
        if ids and size + more > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += more
    yield ids, texts


def benchmark_matches(docs: DataFrame, bench: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES, keep_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, the runs of hit words, the
    items with a window in it, and for each (row, item) the longest verbatim
    match with its place in both.

    A null or wordless text has no words and no hits; null, empty or wordless
    benchmark texts have no window. An item of fewer than ``width`` words is one
    window. Items with one item_id count once; one without an id hits words but
    is not listed. Repeated rows are judged one by one. Other columns are
    ignored, but for those of ``keep``.
    """
    state = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(0).cast("bigint").alias("n_words"),
        *(F.array().cast(kind).alias(name) for name, kind in (
            ("runs", "array<struct<s:bigint,e:bigint>>"), ("items", "array<bigint>"),
            ("matches", "array<struct<item_id:bigint,words:bigint,doc_word:bigint,item_word:bigint>>"),
        )), *keep,
    )
    schema = StructType([*StructType.fromDDL(_STATE).fields, *(StructField(c, docs.schema[c].dataType) for c in keep)])
    context = docs.sparkSession.sparkContext
    for number, (ids, texts) in enumerate(_blocks(bench, block_bytes)):
        if number:
            state = stored(state, "matches")
        index = context.broadcast(build_index(ids, texts, width))

        def run(batches, index=index):
            for batch in batches:
                for part in units.slices(batch):
                    yield _search(index.value, part)

        state = state.mapInArrow(run, schema)
    return state if keep_text else state.drop("text")


def contamination(docs: DataFrame, bench: DataFrame, width: int = 13, one_in: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches) per
    row; contaminated if at least one word in ``one_in`` is hit. See
    ``benchmark_matches`` for the cases."""
    found = benchmark_matches(docs, bench, width, block_bytes)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", _n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "matches",
    ).withColumn("contaminated", _contaminated(one_in))


def _n_hit() -> Column:
    return F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["e"] - r["s"])


def _contaminated(one_in: int) -> Column:
    return F.expr(f"n_hit > 0 and {one_in} * n_hit >= n_words")


def uncontaminated(docs: DataFrame, bench: DataFrame, one_in: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, each judged by its own
    text: a contaminated row takes no other row along, whatever their doc_ids."""
    rest = [c for c in docs.columns if c != "text"]
    own = docs.select("doc_id", "text", F.struct(*(docs[f"`{c}`"] for c in rest)).alias("row"))
    found = benchmark_matches(own, bench, keep_text=True, keep=("row",)).withColumn("n_hit", _n_hit())
    return found.where(~_contaminated(one_in)).select(
        *(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns)
    )
