"""Training-order files of token ids: a keyed Feistel permutation gives every sequence its global slot.

Each task encodes its texts with a public byte-level BPE, ends each with the end id, and packs the stream into sequences of
a fixed length; only the last sequence of a partition is padded, with end ids. Sequences are numbered through all
partitions from their counts. A Feistel network over the smallest even number of bits that holds all numbers, walked
along its cycle until the result is a number in use, is a keyed permutation of the numbers: it gives each sequence its slot
with no sort, table or collision. Slots are dealt by range to shards of a fixed number of sequences, and each shard is one
file of little-endian ids with a fixed stride, so the sequence of slot s starts at byte (s % per_shard) * stride of file
s // per_shard: training reads files in order and resumes at any slot. A file is written under a name of its own and
then moved into place, so a repeated or lost task leaves whole files only.

Defined results: null and empty texts are a single end id; repeated rows are encoded each; an empty table gives no file
and an empty index; very long texts run over many sequences; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwarden.session import materialise, work_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The first id that the vocabulary leaves free.
END = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A longer run of characters without white space, or of white space alone, is cut after every so many of its characters, as
#: merging takes more than linear time.
LONG_RUN = 4096
LONG_RUNS = re.compile(rf"\S{{{LONG_RUN + 1},}}|\s{{{LONG_RUN + 1},}}")
ROUNDS = 6


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text."""
    bpe = encoding(path)
    text = text or ""
    if len(text) <= LONG_RUN:
        return bpe.encode_to_numpy(text, disallowed_special=())
    cuts = [0]
    for run in LONG_RUNS.finditer(text):
        cuts += range(run.start() + LONG_RUN, run.end(), LONG_RUN)
    pieces = [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)])]
    return np.concatenate([bpe.encode_to_numpy(p, disallowed_special=()) for p in pieces])


def feistel(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """The keyed permutation of 0 to total-1, applied to `numbers`."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh64_intdigest(f"{key}:{r}".encode())) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (f >> np.uint64(32))) & mask
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    while (beyond := out >= np.uint64(total)).any():  # walk the cycle back into the numbers in use
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def packed_sequences(docs: DataFrame, length: int, path: str) -> DataFrame:
    """(part, number, ids, n_tokens, doc_ids): each partition's token stream in sequences of `length` ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held, held_docs, size = [], [], 0

        def cut(last: bool = False) -> pa.RecordBatch:
            nonlocal held, held_docs, size, number
            stream = np.concatenate([*held, np.zeros(0, "<u2")]).astype("<u2")
            ends = np.cumsum([len(h) for h in held], dtype=np.int64)
            n = -(-size // length) if last else size // length
            rows = []
            for i in range(n):
                ids = stream[i * length : (i + 1) * length]
                first = int(np.searchsorted(ends, i * length, side="right"))
                past = int(np.searchsorted(ends, i * length + len(ids) - 1, side="right"))
                full = ids if len(ids) == length else np.concatenate([ids, np.full(length - len(ids), END, "<u2")])
                rows.append((part, number + i, full.tobytes(), len(ids), held_docs[first : past + 1]))
            number += n
            rest = stream[n * length :]
            keep = int(np.searchsorted(ends, n * length, side="right"))
            tail, at = [], n * length
            for h in range(keep, len(held)):
                tail.append(stream[at : int(ends[h])])
                at = int(ends[h])
            held, held_docs, size = tail, held_docs[keep:], len(rest)
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
            cols = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)],
                                              names=["part", "number", "ids", "n_tokens", "doc_ids"])

        end = np.array([END], "<u2")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py(), path).astype("<u2")
                held.append(np.concatenate([ids, end]))
                held_docs.append(doc_id)
                size += len(ids) + 1
                if size >= length * 1024:
                    yield cut()
            if size >= length:
                yield cut()
        if size:
            yield cut(last=True)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(pack, "part int, number bigint, ids binary, n_tokens int, doc_ids array<bigint>")


def write_training_order(docs: DataFrame, folder: str, length: int = 4096, per_shard: int = 2048, key: int = 20,
                         path: str = VOCABULARY) -> DataFrame:
    """Write the shard files to `folder`, a URI on shared storage, and return their index.

    Index: slot, shard, row (in the shard), sequence (number before the permutation), n_tokens without padding, doc_ids of
    the texts in it, crc32 of its bytes. Ids take two bytes.
    """
    spark, stored = docs.sparkSession, work_dir(docs.sparkSession, "sequences")
    packed = packed_sequences(docs, length, path)
    packed.write.option("compression", "zstd").parquet(stored)  # ids shrink by 40 % here and in the exchange
    sequences = spark.read.schema(packed.schema).parquet(stored)
    counts = dict(sequences.groupBy("part").agg(F.count("*")).collect())  # one row per partition
    base, total = {}, 0
    for part in sorted(counts):
        base[part], total = total, total + counts[part]
    offsets = spark.sparkContext.broadcast(base)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = np.array([offsets.value[p] for p in batch.column("part").to_pylist()], np.int64)
            sequence = start + batch.column("number").to_numpy()
            slot = feistel(sequence, total, key)
            pack = zstandard.ZstdCompressor(level=3).compress
            packed_ids = pa.array([pack(x.as_py()) for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), pa.array(sequence),
                 batch.column("n_tokens"), batch.column("doc_ids"), packed_ids],
                names=["slot", "shard", "sequence", "n_tokens", "doc_ids", "ids"])

    def write(rows: pa.Table) -> pa.Table:
        import zlib

        from pyarrow import fs

        rows = rows.sort_by("slot")
        store, where = fs.FileSystem.from_uri(folder)
        store.create_dir(where, recursive=True)
        shard = rows.column("shard")[0].as_py()
        own = f"{where}/.shard-{shard:08d}-{uuid.uuid4().hex}"
        unpack = zstandard.ZstdDecompressor().decompress
        ids = [unpack(x.as_py()) for x in rows.column("ids")]
        with store.open_output_stream(own) as out:
            for x in ids:
                out.write(x)
        store.move(own, f"{where}/shard-{shard:08d}.bin")
        slot = rows.column("slot").to_numpy()
        return pa.table({"slot": slot, "shard": rows.column("shard"), "row": (slot % per_shard).astype(np.int32),
                         "sequence": rows.column("sequence"), "n_tokens": rows.column("n_tokens"),
                         "doc_ids": rows.column("doc_ids"), "ids_crc32": np.array([zlib.crc32(x) for x in ids], np.int64)})

    placed = sequences.mapInArrow(place, "slot bigint, shard int, sequence bigint, n_tokens int, doc_ids array<bigint>, "
                                         "ids binary")
    index = placed.groupBy("shard").applyInArrow(
        write, "slot bigint, shard int, row int, sequence bigint, n_tokens int, doc_ids array<bigint>, ids_crc32 bigint")
    return materialise(index, "index")


def new_folder(spark: SparkSession) -> str:
    """A folder for shard files under the shared work folder, as a URI of the file system that Spark writes it to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark, "shards"))
    uri = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri


def read_slots(folder: str, first: int, count: int, length: int = 4096, per_shard: int = 2048) -> Iterator[np.ndarray]:
    """Sequences of `count` slots from slot `first` on, by seeking to the first one and reading on."""
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(folder)
    stride, slot, end = 2 * length, first, first + count
    while slot < end:
        with store.open_input_file(f"{where}/shard-{slot // per_shard:08d}.bin") as f:
            f.seek(slot % per_shard * stride)
            for _ in range(min(end, (slot // per_shard + 1) * per_shard) - slot):
                yield np.frombuffer(f.read(stride), "<u2")
                slot += 1
