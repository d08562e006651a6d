"""Repeats, token files, packing and the encoder."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from tallyframe.llm import packing, repeats, token_files, tokens
from tallyframe.session import scratch_path
from llm.conftest import got

PATH = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("aB' 'sréll\n\t\r1２中!_😀 　\x85½<|>")), max_size=30), st.text(max_size=20)), max_size=6))
def test_encoder_equals_the_library(texts):
    t = Tokenizer.from_file(PATH) if not hasattr(test_encoder_equals_the_library, "t") else test_encoder_equals_the_library.t
    test_encoder_equals_the_library.t = t
    t.encode_special_tokens = True
    ids, first = tokens.encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_asks_the_library_once_a_batch(reference):
    """Distinct runs of white space too go to the library together with all other words."""
    texts = [f"it's{' ' * k}a{k}\n{chr(9) * k}b\u3000{k}'ll" for k in range(1, 200)] + ["", None, "'s", "<|endoftext|>", "\x00\xad\n"]
    encoder, calls = tokens.Encoder(PATH), []
    library = encoder._tokenizer

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(library, name)

    encoder._tokenizer = Counted()
    for times in (1, 1):  # the second time every word is known
        ids, first = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [reference(x) for x in texts]
        assert len(calls) == times


def test_encoder_needs_a_byte_level_vocabulary(tmp_path):
    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "prefix.json"))
    with pytest.raises(ValueError, match="byte-level"):
        tokens.Encoder(str(tmp_path / "prefix.json"))


def plain_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t) + 1)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 64])
def test_repeats(spark, cases, length):
    _, rows = cases
    inner = " ".join(f"shared {i} passage" for i in range(24))
    rows = [r for r in rows if r[0] != 16] + [
        (40 + k, "".join(f"{k}-{i} " for i in range(60)) + inner[k : len(inner) - 3 * k] + "".join(f" {i}+{k}" for i in range(60))) for k in range(6)
    ]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, row int").repartition(4)
    assert got(repeats.without_repeats(frame, length).drop("spans")) == sorted(plain_repeats(rows, length), key=repr)


def test_passages_in_two_documents(spark):
    """Passages of over 50 words count from 400 bytes on; other documents are left alone."""
    own = [" ".join(f"{k}own{i}" for i in range(90)) for k in range(6)]
    long, short = " ".join(f"passage{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60))
    assert len(long) >= 400 > len(short)
    texts = [f"{own[0]}/{long}/{own[0][::-1]}", f"{long}|{own[1]}", f"{own[2]}/{short}/", f"{short}|{own[3]}", own[4], own[5]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.without_repeats(frame).collect()}
    assert rows == {i: (len(t), *((len(long), 1) if i < 2 else (0, 0))) for i, t in enumerate(texts)}


def test_bytes_of_a_passage_decide(spark):
    """Of passages of over 50 words, 400 bytes in fewer letters go, 399 bytes stay."""
    own = [" ".join(f"{k}own{i}" for i in range(90)) for k in range(4)]
    words = [" ".join(f"{k}é{i}" for i in range(55)) for k in "ab"]
    gone, stays = (w + "x" * (size - len(w.encode())) for w, size in zip(words, (400, 399)))
    assert (len(gone.encode()), len(stays.encode())) == (400, 399) and len(gone) < 399
    rows = list(enumerate([f"{own[0]}/{gone}/{own[0][::-1]}", f"{gone}|{own[1]}", f"{own[2]}/{stays}/", f"{stays}|{own[3]}"]))
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).drop("spans")
    assert got(found) == sorted(plain_repeats(rows, 400), key=repr)
    assert [(r[2], r[3]) for r in sorted(got(found))] == [(400, 1), (400, 1), (0, 0), (0, 0)]


def test_repeats_in_many_copies_of_a_row(spark):
    """Copies of an id and text are cut once; an edge held against them is still found."""
    text = " ".join(f"word{i}" for i in range(450))
    part = "own start " * 3 + text[700:1500] + " own end"
    rows = [(1, text)] * 600 + [(2, part), (3, "x" * 300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert repeats.repeated_spans(frame).count() == 2
    found = repeats.without_repeats(frame).select("doc_id", "n_bytes", "n_removed", "n_spans").groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count()
    assert got(found) == [(1, len(text), len(text), 1, 600), (2, len(part), 800, 1, 1), (3, 300, 0, 0, 1)]


def test_repeats_of_nothing(nothing):
    assert repeats.without_repeats(nothing).count() == 0


def test_token_files(spark, cases, reference):
    frame, rows = cases
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(frame, folder, PATH, 2, block_bytes=2000)
    back = token_files.read_tokens(spark, folder).collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*reference(t), 2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(((r[0], r[1], r[2], zlib.crc32(r[3])) for r in back), key=lambda r: r[1]) == want
    digest, raw = token_files.read_dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks").collect()
    assert len(blocks) > 2 and {b["dictionary_sha256"] for b in blocks} == {digest}
    block = next(b for b in blocks if 14 in b["doc_ids"])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    alone = token_files.frame_ids(block, block["doc_ids"].index(14), reader)
    assert alone.tolist() == [*reference(dict(rows)[14]), 2]


def test_token_files_of_nothing(nothing):
    assert token_files.token_files(nothing, PATH).count() == 0


def best_fit_decreasing(lengths, capacity):
    """Sequences that a plain best fit opens."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_runs_are_best_fit_decreasing(lengths):
    histogram = Counter(lengths)
    used = defaultdict(list)
    runs = packing.best_fit_runs(histogram, 24)
    for k, (length, number, first, per, offset) in enumerate(runs):
        later = [r for r in runs[k + 1 :] if r[0] == length]
        for j in range((later[0][1] if later else histogram[length]) - number):
            used[first + j // per].append((offset + j % per * length, length))
    assert sum(len(v) for v in used.values()) == len(lengths)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 24
    assert sorted(24 - sum(n for _, n in v) for v in used.values()) == best_fit_decreasing(lengths, 24)


def test_packing(spark, cases, reference):
    frame, rows = cases
    found = packing.packed(frame, PATH).collect()
    want, lengths = [], []
    for i, t in rows:
        ids = [*reference(t), 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, crc(ids[a:b])))
            lengths.append(b - a)
    assert sorted(((*r[:4], zlib.crc32(r[4])) for r in found), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts)[:-1])]))
        assert sum(n for _, n in parts) <= 2048
    assert len(by) == len(best_fit_decreasing(lengths, 2048))


def test_packing_of_nothing(nothing):
    assert packing.packed(nothing, PATH).count() == 0
