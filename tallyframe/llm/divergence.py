"""How the sources of a language differ in their words, by shared count trees.

Every (language, source) group has a segment tree over the term ids of its
language: a leaf is a count, an inner node its two children. Nodes are
hash-consed, so equal runs of counts are one node, whichever group or place
they come from. Two groups are compared by walking both trees at once: the walk
keeps one entry for each pair of nodes that it meets on a level, with the number
of places where the pair lies, so an equal pair is followed, and at the leaves
priced, once.

Term ids are dealt to blocks of bounded size by a hash of the term; a block is
the subtree of its ids, and the levels above are sums over blocks, which Spark
adds up. Inside a block terms with equal counts lie side by side, so that equal
subtrees are common. A very frequent term is one leaf, whatever its count;
counts are summed in the scan's tasks before any shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import units
from tallyframe.session import stored

SCALE = 1_000_000_000
LEAST_DOCS = 3
RANKS = 200
BLOCK_TERMS = 16_384
BLOCK_CELLS = 1 << 21  # terms times groups of a block, and node pairs walked at once
TILE = 256  # groups that a block compares with as many others

# [^\x00-\x40\x5B-\x60\x7B-\x7F]+ : letters of ASCII and bytes of longer code points.
_TERM = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of each occurrence and the terms by code, as exact strings."""
    data, offsets = units.column_bytes(texts)
    starts, ends, first = units.words(data, offsets, _TERM)
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    letters = units.LOWER[data[_TERM[data]]]
    found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    found = found.dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    return row, found.indices.to_numpy().astype(np.int64), found.dictionary


def _counted(batches):
    """(lang, source, term, n, docs): occurrences, and rows with the term, summed
    over slices of a few megabytes."""
    for batch in batches:
        for piece in units.slices(batch, limit=4 * units.PIECE):
            row, code, terms = _terms(piece.column("text"))
            langs, sources = (piece.column(c).dictionary_encode() for c in ("lang", "source"))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            width = max(len(terms), 1)
            places, n = np.unique(row * width + code, return_counts=True)  # a term in a row
            row, code = np.divmod(places, width)
            places, back = np.unique(group[row] * width + code, return_inverse=True)  # in a group
            total = np.zeros(len(places), np.int64)
            np.add.at(total, back, n)
            docs = np.bincount(back, minlength=len(places))
            group, code = np.divmod(places, width)
            lang, source = np.divmod(group, max(len(sources.dictionary), 1))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), terms.take(pa.array(code)),
                 pa.array(total), pa.array(docs, pa.int64())],
                ["lang", "source", "term", "n", "docs"])


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n, counts) of the terms in at least ``least_docs`` rows of
    their language; counts holds (source, n) of the sources that have it."""
    each = docs.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    summed = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        summed.groupBy("lang", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
        .where(F.col("docs") >= least_docs).drop("docs")
    )


def shared_tree(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hash-consed trees over the rows of ``counts`` (group, term id); the number
    of ids is a power of two.

    Returns (count of each leaf node, children of the nodes of each level from
    the leaves up, root of each group). Nodes of a level that have equal children
    are one node, in all groups.
    """
    leaves, node = np.unique(counts, return_inverse=True)
    node = node.reshape(counts.shape).astype(np.int64)
    levels, size = [], len(leaves)
    while node.shape[1] > 1:
        key, up = np.unique(node[:, 0::2] * size + node[:, 1::2], return_inverse=True)
        node = up.reshape(node.shape[0], -1).astype(np.int64)
        levels.append((key // size, key % size))
        size = len(key)
    return leaves, levels, node[:, 0]


def walk(levels: list[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray):
    """Walk the trees with roots a[i] and b[i] at once, for all i: (i, leaf of a,
    leaf of b, number of term ids where they meet)."""
    pair, times = np.arange(len(a)), np.ones(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        left, right = levels[k]
        size = len(levels[k - 1][0]) if k else int(max(left.max(), right.max())) + 1
        key = np.concatenate([(pair * size + left[a]) * size + left[b], (pair * size + right[a]) * size + right[b]])
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.concatenate([times, times])[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, times = key[first], np.add.reduceat(times, first)
        rest, b = np.divmod(key, size)
        pair, a = np.divmod(rest, size)
    return pair, a, b, times


def _prices(leaves: np.ndarray, totals: list[int], terms: int) -> np.ndarray:
    """p by (group, leaf); Python numbers, since SCALE * count may pass 64 bits."""
    return np.array([[1 + SCALE * (c + 1) // (n + terms) for c in leaves.tolist()] for n in totals], np.int64)


def _count_matrix(terms: pa.Table, sources: list[str]) -> np.ndarray:
    """Counts by (group, term id). Ids follow the counts, so that equal terms lie
    side by side; they are filled up to a power of two with leaves of -1."""
    at = {s: i for i, s in enumerate(sources)}
    lists = terms.column("counts").combine_chunks()
    cells = lists.flatten()
    counts = np.zeros((len(sources), terms.num_rows), np.int64)
    row = np.array([at[s] for s in cells.field("source").to_pylist()], np.int64)
    counts[row, np.repeat(np.arange(terms.num_rows), np.diff(lists.offsets.to_numpy()))] = cells.field("n").to_numpy()
    missing = (1 << (terms.num_rows - 1).bit_length()) - terms.num_rows
    return np.pad(counts[:, np.lexsort(counts[::-1])], ((0, 0), (0, missing)), constant_values=-1)


def _block_sums(key, terms, groups):
    """(lang, source, item, value) of one block: for every two of its groups the
    value summed over its terms. Of two different tiles only groups of either
    meet; the others meet in the block of their own tile."""
    sources = groups.column("source").to_pylist()
    worth = np.zeros((len(sources), len(sources)), np.int64)
    first, second = np.triu_indices(len(sources), 1)
    two = key[2].as_py()
    if two["a"] != two["b"]:
        tile = groups.column("tile").to_numpy()
        across = tile[first] != tile[second]
        first, second = first[across], second[across]
    if terms.num_rows and len(first):
        leaves, levels, roots = shared_tree(_count_matrix(terms, sources))
        price = _prices(leaves, groups.column("n").to_pylist(), groups.column("v")[0].as_py())
        step = max(BLOCK_CELLS >> len(levels), 1)
        for i in range(0, len(first), step):
            f, s = first[i : i + step], second[i : i + step]
            pair, a, b, times = walk(levels, roots[f], roots[s])
            real = leaves[a] >= 0
            pair, a, b, times = pair[real], a[real], b[real], times[real]
            p, q = price[f[pair], a], price[s[pair], b]
            square = (p - q) * (p - q)
            np.add.at(worth, (f[pair], s[pair]), square // q * times)
            np.add.at(worth, (s[pair], f[pair]), square // p * times)
    one, other = np.concatenate([first, second]), np.concatenate([second, first])
    names = pa.array(sources, pa.string())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(one), pa.string()), "source": names.take(pa.array(one)),
                     "item": names.take(pa.array(other)), "value": pa.array(worth[one, other], pa.int64())})


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source).

    Part ``pair`` compares a group with every other group of its language, part
    ``term`` names the terms that it uses more than its language does, the first
    ``ranks`` of them. Nulls are empty strings, which are a language and a source
    like any other. A repeated row counts again, as a document of its own. A
    language without kept terms has pairs of value 0 and no terms; a language
    with one source has no pairs; an empty table gives no rows. Columns besides
    the three are ignored.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = stored(kept_terms(docs, least_docs), "terms")

    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    cells = kept.select("lang", "term", F.col("n").alias("lang_count"), F.explode("counts").alias("c"))
    of_group = cells.groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    groups = (
        docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "v", "lang_n")])
    )
    groups = stored(groups, "groups")

    sizes = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count("*").alias("s")).select(
        "lang", F.expr(f"greatest(ceil(v / {BLOCK_TERMS}), ceil(v * least(s, {2 * TILE}) / {BLOCK_CELLS}), 1)").cast("int").alias("blocks"),
        F.ceil(F.col("s") / TILE).cast("int").alias("tiles"),
    )
    two = F.expr("explode(flatten(transform(sequence(0, tiles - 1), a -> transform(sequence(a, tiles - 1), b -> struct(a, b)))))").alias("two")

    def tile(source: str) -> str:
        return f"cast(pmod(xxhash64({source}), tiles) AS int)"

    # A block of terms meets two tiles of groups; with few groups there is one tile.
    blocked = (
        kept.join(sizes, "lang").select("lang", "counts", "tiles", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), two)
        .withColumn("counts", F.expr(f"filter(counts, c -> {tile('c.source')} IN (two.a, two.b))"))
    )
    spread = (
        groups.join(sizes, "lang").select("*", two).withColumn("tile", F.expr(tile("source"))).where("tile IN (two.a, two.b)")
        .select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "two", "tile", "source", "n", "v")
    )
    keys = ["lang", "block", "two"]
    sums = (
        blocked.select(*keys, "counts").groupBy(*keys).cogroup(spread.groupBy(*keys))
        .applyInArrow(_block_sums, "lang string, source string, item string, value bigint")
    )
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    chances = cells.select("lang", "term", "lang_count", "c.source", F.col("c.n").alias("count")).join(groups, ["lang", "source"])
    priced = chances.select("lang", "source", F.col("term").alias("item"), _chance("count", "n").alias("p"), _chance("lang_count", "lang_n").alias("q"))
    terms = priced.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(terms, "term", ranks))


def _chance(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)), in decimals: exact for any count."""
    return F.expr(f"1 + (cast({count} + 1 AS decimal(20,0)) * {SCALE}) div cast({total} + v AS decimal(20,0))")
