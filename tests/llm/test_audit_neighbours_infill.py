"""Source divergence, nearest neighbours and fill-in-the-middle, against plain versions."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle import DATA
from tallyframe.llm import divergence, graph_index, infill, reachable
from llm.conftest import got

# ------------------------------------------------------------------ fill-in-the-middle


def plain_infill(rows):
    for i, t in rows:
        t = t or ""
        digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * j : 8 * j + 8], 16) for j in range(4)]
        n = len(t)
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            yield (i, n, "plain", None, None, t)
        elif h[3] % 100 < 20:
            yield (i, n, "spm", low, high - low, f"<S>{t[high:]}<P>{t[:low]}<M>{t[low:high]}")
        else:
            yield (i, n, "psm", low, high - low, f"<P>{t[:low]}<S>{t[high:]}<M>{t[low:high]}")


@pytest.mark.parametrize("p", [infill.Params(), infill.Params(mean_chunk=8, least_chunk=16, most_chunk=40, memo_bytes=4000)])
def test_infill(spark, cases, nothing, p):
    frame, rows = cases
    made = infill.infilled(frame, p)
    assert got(made) == sorted(plain_infill(rows), key=repr)
    back = made.select("doc_id", infill.restored(F.col("form"), F.col("output"), p).alias("text"))
    assert got(back) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert infill.infilled(nothing, p).count() == 0


def test_infill_with_parts_of_marks(spark):
    parts = ["<", "P", ">", "<S", "M>", "<P", "<P>", "é", "x" * 300, "日本", " ", "<<", "S>"]
    rows = [(i, "".join(parts[(i * 7 + j * j) % len(parts)] for j in range(i % 9))) for i in range(400)]
    made = infill.infilled(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got(made) == sorted(plain_infill(rows), key=repr)
    assert {r[2] for r in plain_infill(rows)} == {"plain", "psm", "spm"}
    back = made.select("doc_id", infill.restored(F.col("form"), F.col("output")).alias("text"))
    assert got(back) == sorted(rows, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("<PSM>é日a"), max_size=9).map(str.encode), max_size=6))
def test_summaries_combine_to_the_summary_of_the_whole(chunks):
    marks = infill.Params().marks
    whole = infill.Summary()
    for c in chunks:
        whole = infill.combined(whole, infill.summary(c, marks) if c else infill.Summary(), marks)
    text = b"".join(chunks)
    assert whole == (infill.summary(text, marks) if text else infill.Summary())


def test_memo_looks_at_the_bytes():
    known = infill.Memo(infill.Params())
    assert known.get(5, b"abc").units == 3
    assert known.get(5, "éé".encode()).units == 2 and known.get(5, b"abc").units == 3
    assert known.hits == 1


def test_shared_passages_share_chunks():
    p = infill.Params(mean_chunk=32, least_chunk=16)
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 122, 4000, dtype=np.uint8)
    texts = [np.concatenate([rng.integers(97, 122, k, dtype=np.uint8), shared]) for k in (13, 450)]
    chunks = []
    for t in texts:
        cuts, _ = infill.borders(t, np.array([0, len(t)]), infill.units.running(t), p)
        chunks.append({t[a:z].tobytes() for a, z in zip(cuts, cuts[1:])})
    assert len(chunks[0] & chunks[1]) > 0.9 * len(chunks[0])


# ------------------------------------------------------------------ source divergence


def plain_audit(rows, least=3, ranks=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, d in docs[lang].items() if d >= least]
        mine = [s for g, s in groups if g == lang]
        n = {s: sum(count[lang, s][t] for t in kept) for s in mine}

        def chance(c, total):
            return 1 + 10**9 * (c + 1) // (total + len(kept))

        pairs = []
        for other in mine:
            if other != source:
                value = 0
                for t in kept:
                    p, q = chance(count[lang, source][t], n[source]), chance(count[lang, other][t], n[other])
                    value += (p - q) ** 2 // q
                pairs.append((other, value))
        terms = []
        for t in kept:
            p = chance(count[lang, source][t], n[source])
            q = chance(sum(count[lang, s][t] for s in mine), sum(n.values()))
            if count[lang, source][t] and p > q:
                terms.append((t, (p - q) ** 2 // q))
        for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out, key=repr)


def _corpus():
    rng = np.random.default_rng(3)
    words = ["Über", "the", "THE", "a1b", "été", "x-y", "日本", "don't", "Z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(300):
        chosen = rng.choice(len(words), rng.integers(0, 40), p=np.arange(len(words), 0, -1) / (len(words) * (len(words) + 1) / 2))
        rows.append((" ".join(words[k] for k in chosen), ["en", "de", None][i % 3], None if i % 11 == 0 else f"s{i % 7 if i % 2 else 0}"))
    rows += [(None, "en", "only nulls"), ("", "", "empty"), ("rare", "fr", "one"), ("rarer", "fr", "two"), ("solo solo", "it", "one")]
    return rows + rows[:40]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, i, 1.5, "k") for i, r in enumerate(rows)], "text string, lang string, source string, n bigint, counts double, item string")


def test_audit(spark):
    reachable(spark)
    rows = _corpus()
    frame = _frame(spark, rows).repartition(5)
    assert got(divergence.audit(frame)) == plain_audit(rows)
    assert got(divergence.audit(frame, least_docs=1, ranks=7)) == plain_audit(rows, 1, 7)
    assert divergence.audit(frame.where("false")).count() == 0


def test_audit_in_small_blocks_and_tiles(spark, monkeypatch):
    reachable(spark)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 16)
    monkeypatch.setattr(divergence, "TILE", 2)
    rows = _corpus()
    assert got(divergence.audit(_frame(spark, rows))) == plain_audit(rows)


def test_audit_without_terms(spark):
    reachable(spark)
    rows = [(None, None, None), (None, None, "a"), ("12 34", "", "b")]
    assert got(divergence.audit(_frame(spark, rows))) == plain_audit(rows)


def test_one_price_for_equal_nodes():
    counts = np.tile(np.array([[1, 0, 0, 2], [0, 3, 0, 0], [1, 0, 0, 2]]), (1, 256))
    leaves, levels, roots = divergence.shared_tree(counts)
    assert roots[0] == roots[2] != roots[1]
    assert all(len(left) == 2 for left, _ in levels[2:])  # one subtree for either content, on every level
    pair, a, b, times = divergence.walk(levels, roots[[0, 0]], roots[[1, 2]])
    found = {(int(i), int(leaves[x]), int(leaves[y])): int(t) for i, x, y, t in zip(pair, a, b, times)}
    assert found == {(0, 1, 0): 256, (0, 0, 3): 256, (0, 0, 0): 256, (0, 2, 0): 256, (1, 1, 1): 256, (1, 0, 0): 512, (1, 2, 2): 256}


def test_prices_of_counts_beyond_64_bits():
    big = 10**13
    price = divergence._prices(np.array([0, big]), [2 * big], 4)
    assert price.tolist() == [[1 + 10**9 // (2 * big + 4), 1 + 10**9 * (big + 1) // (2 * big + 4)]]


# ------------------------------------------------------------------ nearest neighbours


def plain_neighbours(rows, k, every=100):
    rows = {(i, tuple(x + 0.0 for x in v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for i in {i for i, _ in rows if i % every == 0}:
        near = {}
        for own in [np.array(v) for j, v in rows if j == i]:
            for j, v in rows:
                if j != i and len(v) == len(own):
                    d = float(np.sqrt(((np.array(v) - own) ** 2).sum()))
                    near[j] = min(d, near.get(j, d))
        out += [(i, r + 1, j, d) for r, (j, d) in enumerate(sorted(near.items(), key=lambda x: (x[1], x[0]))[:k])]
    return sorted(out)


def _same(found, wanted):
    found = sorted(tuple(r) for r in found.collect())
    assert [r[:3] for r in found] == [r[:3] for r in wanted]
    assert np.allclose([r[3] for r in found], [r[3] for r in wanted], rtol=1e-12, atol=0)


def test_neighbours_of_odd_rows(spark):
    reachable(spark)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(350)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(100, [9.0, 9.0, 9.0, 9.0]), (200, [1.0, 2.0, 3.0, 4.0])]
    rows += rows[:20] + [(None, [1.0] * 4), (400, None), (401, []), (402, [0.0] * 4), (403, [1.0, None, 1.0, 1.0]), (404, [1.0, float("nan"), 1.0, 1.0])]
    rows += [(405, [1.0, float("inf"), 1.0, 1.0]), (500, [1.0, 2.0]), (501, [2.0, 2.0]), (600, [3.0, 2.0, 1.0]), (700, [-0.0, 0.0, 0.0, 0.0]), (-101, [1e30, 1.0, 1.0, 1.0]), (800, [-0.0, 1.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2, "v") for r in rows], "vec_id bigint, embedding array<double>, node int, rank int, vector string")
    _same(graph_index.neighbours(frame.repartition(3)), plain_neighbours(rows, 10))
    small = graph_index.Params(shard_rows=60, degree=8, build_beam=16, search_beam=32, batch=16)
    _same(graph_index.neighbours(frame, k=3, p=small), plain_neighbours(rows, 3))
    assert graph_index.neighbours(frame.where("false")).count() == 0


def test_every_node_is_reached():
    rng = np.random.default_rng(4)
    # Far groups, a line, and many equal distances.
    points = np.concatenate([rng.normal(c * 1000, 1, (150, 8)) for c in range(5)] + [np.outer(np.arange(100), np.ones(8))]).astype(np.float32)
    edges, entries = graph_index.grow(points, graph_index.Params(degree=6, build_beam=12, batch=32))
    met, border = set(entries.tolist()), set(entries.tolist())
    while border:
        border = {int(e) for v in border for e in edges[v] if e >= 0} - met
        met |= border
    assert met == set(range(len(points))) and (edges != np.arange(len(points))[:, None]).all()
    assert all(len(set(e[e >= 0].tolist())) == (e >= 0).sum() for e in edges)


def test_pruning_keeps_diverse_edges():
    points = np.array([[0, 0], [1, 0], [2, 0], [0, 3], [-9, 0], [0, 0]], np.float32)
    ids = np.array([[1, 2, 3, 4, 0, 1, -1]])
    squares = (points * points).sum(1)
    far = graph_index._distances(points, squares, ids, points[:1]).astype(np.float32)
    # 2 is nearer to 1 than to 0, so it goes.
    assert graph_index.robust_prune(points, squares, np.array([0]), ids, far, 4, 1.2).tolist() == [[1, 3, 4, -1]]


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="no test tables here")
@pytest.mark.parametrize("p", [graph_index.Params(), graph_index.Params(shard_rows=300)])
def test_recall(spark, p):
    reachable(spark)
    frame = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in frame.collect()]
    wanted = {r[:1] + r[2:3] for r in plain_neighbours(rows, 10)}
    found = graph_index.neighbours(frame, p=p).collect()
    assert len(found) == len(wanted) and len({(r[0], r[2]) for r in found} & wanted) >= 0.9 * len(wanted)
