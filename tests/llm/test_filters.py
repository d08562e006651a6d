"""Quality rules, decontamination and near duplicates against plain Python."""

import hashlib
import math
import re
from collections import Counter

import pytest
import xxhash

from tallyframe.llm import decontamination, near_dup, quality_rules
from tallyframe.llm.components import components
from llm.conftest import got

LOW = {i: i + 32 for i in range(65, 91)}
SPACE = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    w = re.findall(SPACE, text or "")
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def cells(text, buckets):
    w = re.findall(SPACE, text or "")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    two = [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(one, w[1:])]
    return [signed(h) % buckets for h in one + two]


def test_quality_rules(spark, cases):
    frame, rows = cases
    buckets, trusted = 512, {1, 16}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(cells(t, buckets))
        if i in trusted:
            target.update(cells(t, buckets))
    a, b = sum(target.values()) + buckets, sum(raw.values()) + buckets
    weight = [round(4096 * (math.log((target[c] + 1) / a) - math.log((raw[c] + 1) / b))) for c in range(buckets)]
    want = []
    for i, t in rows:
        n, *rest = plain_counts(t)
        own = cells(t, buckets)
        llr = sum(weight[c] for c in own) / max(len(own), 1) / 4096
        failed = n < 50 or 100 * rest[3] > 50 * n
        want.append((i, n, *rest, failed, llr, not failed and llr >= -0.1))
    ids = spark.createDataFrame([(1,), (1,), (16,), (None,), (99,)], "doc_id bigint")
    found = got(quality_rules.quality_rules(frame, ids, buckets=buckets))
    assert [r[:7] + r[8:] for r in found] == [r[:7] + r[8:] for r in sorted(want, key=repr)]
    assert all(math.isclose(x[7], y[7], abs_tol=1e-12) for x, y in zip(found, sorted(want, key=repr)))


def test_held_out_good_rows_and_copies_are_kept(spark):
    """Clean texts outside the target, each with words of its own, and a large
    group of their copies; the second population is refused."""
    def text(i, kind):
        return " ".join(f"{kind}{(i * 37 + j * 11) % 400}" if j % 3 else f"own{i}x{j}" for j in range(120))

    rows = [(i, text(i, "clean")) for i in range(80)] + [(100 + i, text(100 + i, "junk")) for i in range(40)]
    rows += [(200 + i, text(70, "clean")) for i in range(300)] + [(None, text(71, "clean"))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    ids = spark.createDataFrame([(i,) for i in range(40)], "doc_id bigint")
    found = quality_rules.quality_rules(frame, ids, prior=quality_rules.PRIOR).collect()
    assert {r["doc_id"] for r in found if not r["kept"]} == set(range(100, 140))
    assert len({r["llr"] for r in found if r["doc_id"] == 70 or (r["doc_id"] or 0) >= 200}) == 1
    raw, target = Counter(), Counter()
    for t in {t for _, t in rows}:
        raw.update(cells(t, 1 << 16))
        if t in {t for i, t in rows if i is not None and i < 40}:
            target.update(cells(t, 1 << 16))
    share, p = sum(target.values()) / sum(raw.values()), quality_rules.PRIOR
    own = cells(rows[5][1], 1 << 16)
    want = sum(round(4096 * math.log((target[c] + p) / (raw[c] * share + p))) for c in own) / len(own) / 4096
    assert math.isclose(next(r["llr"] for r in found if r["doc_id"] == 5), want, abs_tol=1e-12)
    assert quality_rules.acceptable(frame, ids).where("doc_id >= 200").count() == 300


def test_quality_rules_without_target_and_rows(spark, cases, nothing):
    none = spark.createDataFrame([], "doc_id bigint")
    assert {r["llr"] for r in quality_rules.quality_rules(cases[0], none, buckets=64).collect()} == {0.0}
    assert quality_rules.quality_rules(nothing, none, buckets=64).count() == 0
    assert quality_rules.acceptable(cases[0], none).columns == cases[0].columns


def doc_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_decontamination(spark, cases, block_bytes):
    frame, rows = cases
    prose = rows[0][1]
    bench = [(10, prose[:150]), (9, prose[200:330]), (9, "three four"), (8, "One"), (7, ""), (6, None), (5, "?!"), (None, "the line other"), (10, prose[:150])]
    table = spark.createDataFrame([(*b, "x") for b in bench], "item_id bigint, text string, doc_id string")
    windows = []
    for item, text in bench:
        w = doc_words(text)
        windows += [(item, w[k : k + 13]) for k in range(max(len(w) - 12, 1)) if w]
    want = []
    for i, t in rows:
        w = doc_words(t)
        hit, items = set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    items.add(item)
        items.discard(None)
        named = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(items), named, bool(hit) and 20 * len(hit) >= len(w)))
    found = decontamination.contamination(frame, table, block_bytes=block_bytes)
    assert got(found.drop("matches")) == sorted(want, key=repr)
    first = found.where("doc_id = 1").head()
    longest = {m["item_id"]: (m["words"], m["doc_word"], m["item_word"]) for m in first["matches"] if m["item_id"] == 10}
    assert longest[10] == (len(doc_words(prose[:150])), 0, 0) or longest[10][0] >= 13


def test_decontamination_of_nothing(spark, cases, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination(nothing, none).count() == 0
    clean = decontamination.uncontaminated(cases[0], none)
    assert clean.columns == cases[0].columns and clean.count() == cases[0].count()


def plain_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, (t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            low[top(k)] = min(low.get(top(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = low.get(top(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return out


def near_rows(rows):
    """Copies of one text with few and with many changes, links in a chain."""
    base = [f"t{i * 31 % 101}x{i}" for i in range(200)]
    chain, out = list(base), list(rows)
    for j in range(12):
        chain[j * 16 + 3] = f"chain{j}"
        out.append((100 + j, " ".join(chain)))
    for j in range(30):
        changed = list(base)
        for k in range(1 + j % 6):
            changed[(j * 13 + k * 29) % 200] = f"edit{j % 4}"
        out.append((300 - j, " ".join(changed)))
    return out


@pytest.mark.parametrize("prunings", [0, 2])
def test_near_duplicates(spark, cases, prunings):
    rows = near_rows(cases[1])
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, cid int").repartition(4)
    found = near_dup.near_duplicates(frame, near_dup.Params(prunings=prunings))
    assert got(found) == sorted(plain_components(rows), key=repr)


def test_near_duplicates_of_nothing(nothing):
    assert near_dup.near_duplicates(nothing).count() == 0


def test_signature_is_a_circular_shift():
    import numpy as np

    p = near_dup.Params(bands=2, rows=3, universe_bits=8)
    sigma = np.random.default_rng(p.seed)
    a, b = sigma.permutation(256), sigma.permutation(256)
    values = np.array([3, 77, 1 << 40, 999], np.uint64)
    want = [min(int(b[(int(a[int(v) % 256]) + k) % 256]) for v in values) for k in range(6)]
    assert near_dup.signature(values, p).tolist() == want


def ids_and_texts(frame):
    return sorted(((r["doc_id"], r["text"], r["row"], r["words"]) for r in frame.collect()), key=repr)


def with_extras(spark, rows):
    """Rows with columns of names that the filters use themselves."""
    wide = [(i, t, k, {"a": k} if k % 2 else None) for k, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(wide, "doc_id bigint, text string, row int, words map<string,int>").repartition(3)
    return frame, [(i, t, k, w) for i, t, k, w in wide]


def test_filters_act_on_rows(spark, cases):
    """Null and repeated doc_ids: a row that goes takes no other row along."""
    prose = cases[1][0][1]
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(None, prose), (None, "too short"), (1, prose), (1, "too short"), (1, prose), (None, None), (2, other)]
    frame, wide = with_extras(spark, rows)
    none = spark.createDataFrame([], "doc_id bigint")
    kept = quality_rules.acceptable(frame, none)
    assert kept.columns == frame.columns
    assert ids_and_texts(kept) == sorted((r for r in wide if r[1] in (prose, other)), key=repr)
    bench = spark.createDataFrame([(1, prose)], "item_id bigint, text string")
    kept = decontamination.uncontaminated(frame, bench)
    assert kept.columns == frame.columns
    assert ids_and_texts(kept) == sorted((r for r in wide if r[1] != prose), key=repr)


def test_one_row_of_each_group_stays(spark, cases):
    prose = cases[1][0][1]
    other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in ("other", "third"))
    rows = [(5, prose), (5, prose), (None, prose), (4, prose.replace("w30", "x30")), (None, other), (None, other), (None, third), (4, third), (4, third), (None, None), (None, ""), (7, None)]
    frame, _ = with_extras(spark, rows)
    kept = near_dup.representatives(frame)
    assert kept.columns == frame.columns
    want = [rows[3], (None, other), (4, third), (None, None), (None, ""), (7, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 200)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    want = [(k, 0) for k in range(41)] + [(90, 90), (100, 90)]
    assert got(components(frame)) == sorted(want, key=repr)
    assert components(frame.where("false")).count() == 0
