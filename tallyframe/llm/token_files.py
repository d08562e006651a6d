"""Token ids on disk: one zstandard frame a document, one shared dictionary.

A written folder holds two Parquet tables, so it can lie in any store Spark
writes, is committed as a whole, and a lost executor only repeats a task:

- ``dictionary``: one row, the trained dictionary and its SHA-256;
- ``blocks``: one row for at most ``block_bytes`` of frames, in ascending order
  of (doc_id, text): part and block number, dictionary hash, tokens of the part
  before the block, bytes per id, and the index (doc_ids, lengths, offsets of
  the frames) beside the frames, which lets a reader take one document alone.

The dictionary is trained on the serialized ids of a bounded sample of whole
rows (``sample_rows`` by hash, ``sample_ids`` ids of each). Every document is
encoded, written and read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import tokens, units
from tallyframe.session import scratch_path

_BLOCKS = (
    "part int, block int, dictionary_sha256 string, before bigint, width int, n_tokens bigint, doc_ids array<bigint>, "
    "lengths array<bigint>, offsets array<bigint>, frames binary"
)


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(samples: list[bytes], size: int = 110 << 10) -> bytes:
    """A dictionary of at most ``size`` bytes; plain sample content where there
    is too little to train on, nothing where there is none."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, max(sum(map(len, samples)) // 8, 256)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _sample(docs: DataFrame, path: str, width: int, rows: int, ids: int) -> list[bytes]:
    total = docs.count()
    if not total:
        return []
    bound = min(rows / total, 1.0) * 2.0**63
    picked = docs.where(F.abs(F.xxhash64("doc_id", "text").cast("double")) <= bound).select("text").limit(2 * rows)

    def run(batches):
        for batch in batches:
            for part in units.slices(batch):
                flat, first = tokens.encoder(path).encode(part.column("text"))
                some = [serialized(flat[a : min(b, a + ids)], width) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["ids"])

    return sorted(bytes(r["ids"]) for r in picked.mapInArrow(run, "ids binary").collect())


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int, width: int = 2, block_bytes: int = 4 << 20,
    sample_rows: int = 1000, sample_ids: int = 2048, level: int = 3,
) -> None:
    """Write the ids of every text of ``docs`` (doc_id, text), each followed by
    ``end_id``. A null text is empty; a null doc_id sorts first; rows with one
    doc_id follow each other by text. ``width``: bytes per id, 2 or 4."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    raw = train_dictionary(_sample(docs, path, width, sample_rows, sample_ids))
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def run(batches):
        context = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw))
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, offsets, frames = [], [], [0], []

        def full():
            n = sum(lengths)
            return n, pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in (
                    (part, pa.int32()), (block, pa.int32()), (digest, pa.string()), (before, pa.int64()), (width, pa.int32()),
                    (n, pa.int64()), (doc_ids, pa.list_(pa.int64())), (lengths, pa.list_(pa.int64())),
                    (offsets, pa.list_(pa.int64())), (b"".join(frames), pa.binary()))],
                ["part", "block", "dictionary_sha256", "before", "width", "n_tokens", "doc_ids", "lengths", "offsets", "frames"])

        for batch in batches:
            for piece in units.slices(batch):
                ids, first = tokens.with_end(*tokens.encoder(path).encode(piece.column("text")), end_id)
                for i, doc_id in enumerate(piece.column("doc_id").to_pylist()):
                    own = ids[first[i] : first[i + 1]]
                    frame = context.compress(serialized(own, width))
                    if frames and offsets[-1] + len(frame) > block_bytes:
                        n, out = full()
                        yield out
                        block, before = block + 1, before + n
                        doc_ids, lengths, offsets, frames = [], [], [0], []
                    doc_ids.append(doc_id)
                    lengths.append(len(own))
                    frames.append(frame)
                    offsets.append(offsets[-1] + len(frame))
        if frames:
            yield full()[1]

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _BLOCKS).write.parquet(f"{folder}/blocks")


def frame_ids(block, number: int, decompressor: zstandard.ZstdDecompressor) -> np.ndarray:
    """The ids of one document of a block row, by the offset index alone."""
    a, b = block["offsets"][number], block["offsets"][number + 1]
    raw = decompressor.decompress(bytes(memoryview(block["frames"])[a:b]))
    return np.frombuffer(raw, "<u2" if block["width"] == 2 else "<u4").astype(np.uint32)


def read_dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").head()
    raw = bytes(row["dictionary"])
    if hashlib.sha256(raw).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not have its hash")
    return row["sha256"], raw


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids are little-endian
    unsigned 32-bit. One number per written part passes the driver."""
    digest, raw = read_dictionary(spark, folder)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    bases, base = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        bases[r["part"]] = base
        base += r["n"]

    def run(batches):
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for block in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if block["dictionary_sha256"] != digest:
                    raise ValueError("a block was written with another dictionary")
                ids = [frame_ids(block, i, reader).astype("<u4").tobytes() for i in range(len(block["doc_ids"]))]
                lengths = np.array(block["lengths"], np.int64)
                starts = bases[block["part"]] + block["before"] + np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what was written and read back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path, end_id)
    back = read_tokens(docs.sparkSession, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


