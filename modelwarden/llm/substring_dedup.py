"""Removal of repeated byte strings, by merging Burrows-Wheeler transforms of shards.

A text is parsed into phrases at content-defined anchors: the least 16-byte hash of every window of W positions (the
rightmost one, if equal) is an anchor, so equal strings are parsed alike wherever they stand. Texts are
gathered into shards of bounded size, and each shard sorts the suffixes of its phrase sequences and keeps their
Burrows-Wheeler transform (the phrase before each suffix). The transforms are then merged by refining the interleave round
by round: a block of the merged order, which is a phrase string with an interval in each shard, is carried from strings of
k phrases to strings of k + 1 by the last-to-first step of every shard on its own; only the names and sizes of blocks
are exchanged, blocks of one suffix are dropped, and no suffix is sorted again. The bytes of a block's string are its
common prefix; a string of LENGTH bytes that recurs holds anchors between which at least NEEDED bytes of phrases recur, so
the repeated intervals of that length (or of ROUNDS phrases) hold every candidate, and nothing is lost.

An exact check of the candidates follows. All windows of LENGTH bytes with the same anchor form a segment. Segments of equal
bytes are repeated as they stand. The others can only match where the bytes after the anchor that all their windows hold
recur; there, and only there, each window is hashed. Hashes have 64 bits.

Defined results: null texts are empty; texts shorter than LENGTH lose nothing; a match never crosses texts; repeated rows
are texts of their own, so whole copies of LENGTH bytes or more are removed everywhere; empty tables give an empty
result; very long texts are parsed in pieces that meet; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwarden.session import materialise, release

LENGTH = 400
GRAM, W = 16, 140
NEEDED = LENGTH - GRAM - 2 * (W - 1)
CORE = LENGTH - W + 1
ROUNDS = 4
SHARD_BYTES = 8 << 20
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@cache
def byte_values() -> np.ndarray:
    return np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(BASE), of(INVERSE)


class Hashes:
    """Hashes of any substrings of some bytes, the same wherever they stand."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(10, (len(data) + 1).bit_length())
        up, self.down = powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values()[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (end - start).astype(np.uint64)
        return x ^ (x >> np.uint64(29))


def mixed(*parts: np.ndarray) -> np.ndarray:
    x = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        x = (x ^ p.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x


def owners(data: np.ndarray, hashes: Hashes) -> np.ndarray:
    """The anchor of the window of W grams at each position."""
    n = len(data) - GRAM + 1
    at = np.arange(n)
    key = (hashes.of(at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    span = 1
    while span * 2 <= W:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < W:
        key = np.minimum(key[: len(key) - (W - span)], key[W - span :])
    return (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)


def parse(text: bytes) -> dict[str, np.ndarray]:
    """anchors and phrase of each; for the segments, which belong to the first anchors: start, core, whole.

    Segment i holds the windows from start[i] up to the next start, or to the last window of the text.
    """
    data, windows = np.frombuffer(text, np.uint8), len(text) - LENGTH + 1
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("anchors", "phrases", "start", "core", "whole")}
    if windows < 1:
        return {k: np.zeros(0, np.int64) for k in parts}
    at = 0
    while at < windows:
        # A piece ends where a segment ends, so pieces meet as if there were one.
        local = data[at : at + PIECE + 2 * W + LENGTH]
        h = Hashes(local)
        own = owners(local, h)
        last = at + len(local) >= len(data)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        anchors = own[first]
        if last:
            keep = len(first)
            ends = np.append(anchors[1:], len(local))
        else:
            keep = max(1, int(np.searchsorted(first, PIECE)) - 1)
            ends = anchors[1 : keep + 1]
        phrases = h.of(anchors[:keep], ends[:keep])
        edge = first[keep] if not last else len(local) - LENGTH + 1
        segments = int(np.searchsorted(first[:keep], min(windows - at, edge)))
        start = first[:segments]
        end = np.append(start[1:], min(edge, windows - at))
        parts["anchors"].append(anchors[:keep] + at)
        parts["phrases"].append(phrases)
        parts["start"].append(start + at)
        parts["core"].append(h.of(anchors[:segments], anchors[:segments] + CORE))
        parts["whole"].append(mixed(h.of(start, end - 1 + LENGTH), anchors[:segments] - start))
        if last:
            break
        at += int(edge)
    return {k: np.concatenate(v) for k, v in parts.items()}


def numbered(docs: DataFrame) -> DataFrame:
    """Every document with a number, its size and the hash of its bytes."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("bytes")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "bytes", F.octet_length("bytes").cast("bigint").alias("n_bytes"),
        F.sha2("bytes", 256).alias("sha256"))


SHARD = ("shard bigint, docs binary, sizes binary, order binary, phrases binary, lengths binary, offsets binary, widths binary, "
         "cores binary, wholes binary")


def shard_transforms(rows: DataFrame) -> DataFrame:
    """One row per shard: suffixes sorted by their first ROUNDS phrases, and what the refinement needs of them.

    docs, sizes: number and count of anchors of each text; order: place in the shard's sequence of each sorted suffix;
    phrases, lengths: of the sequence; offsets, widths, cores, wholes: of the segment of each place (width 0: none).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, docs = TaskContext.get().partitionId() << 24, 0, 0, []

        def cut() -> pa.RecordBatch:
            nonlocal shard, held, docs
            seq = {k: np.concatenate([d[k] for _, d in docs]) for k in docs[0][1]}
            n = len(seq["phrases"])
            _, name = np.unique(seq["phrases"], return_inverse=True)
            following = [np.concatenate([name[k:], np.full(min(k, n), -1)]) for k in range(ROUNDS)]
            out = {"shard": part + shard, "docs": np.array([r for r, _ in docs], np.int64).tobytes(),
                   "sizes": np.array([len(d["phrases"]) for _, d in docs], np.int64).tobytes(),
                   "order": np.lexsort(following[::-1]).astype(np.int32).tobytes(), **{k: v.tobytes() for k, v in seq.items()}}
            shard, held, docs = shard + 1, 0, []
            return pa.RecordBatch.from_pylist([out], schema=kinds)

        kinds = pa.schema([("shard", pa.int64())] + [(c.split()[0], pa.binary()) for c in SHARD.split(", ")[1:]])
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("bytes")):
                text = text.as_py()
                p = parse(text)
                if not len(p["start"]):
                    continue
                n, m = len(p["anchors"]), len(p["start"])
                p["phrases"][-1] = mixed(np.array([row]), np.array([0x5EED]))[0]  # the last phrase matches nothing
                pad = np.zeros(n - m, np.int64)
                docs.append((row, {
                    "phrases": p["phrases"], "lengths": np.diff(np.append(p["anchors"], len(text))).astype("<u2"),
                    "offsets": np.concatenate([p["anchors"][:m] - p["start"], pad]).astype("<u2"),
                    "widths": np.concatenate([np.diff(np.append(p["start"], len(text) - LENGTH + 1)), pad]).astype("<u2"),
                    "cores": np.concatenate([p["core"], pad.astype(np.uint64)]),
                    "wholes": np.concatenate([p["whole"], pad.astype(np.uint64)])}))
                held += len(text)
                if held >= SHARD_BYTES:
                    yield cut()
        if docs:
            yield cut()

    return rows.select("row", "bytes").mapInArrow(run, SHARD)


def intervals_of(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first place, past place) of each run of equal keys, where equal keys have neighbouring places."""
    order = np.argsort(places, kind="stable")
    keys, places = keys[order], places[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    past = np.append(first[1:], len(keys))[: len(first)]
    return keys[first], places[first], places[past - 1] + 1


BLOCK_SCHEMA = "shard bigint, block bigint, bytes int, tail int, low int, high int"


def blocks_batch(shard: int, block: np.ndarray, **counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"shard": np.full(len(block), shard, np.int64), "block": block.view(np.int64),
                            **{k: v.astype(np.int32) for k, v in counts.items()}})


def first_blocks(shards: DataFrame) -> DataFrame:
    """Blocks of one phrase: the interval of each phrase in each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                phrases, order = np.frombuffer(r["phrases"], np.uint64), np.frombuffer(r["order"], np.int32)
                lengths = np.frombuffer(r["lengths"], "<u2")
                sorted_phrases = phrases[order]
                key, low, high = intervals_of(sorted_phrases, np.arange(len(order)))
                size = lengths[order[low]]
                yield blocks_batch(r["shard"], key, bytes=size, tail=size, low=low, high=high)

    return shards.select("shard", "order", "phrases", "lengths").mapInArrow(run, BLOCK_SCHEMA)


def extended_blocks(shards: DataFrame, alive: DataFrame, needed: int) -> DataFrame:
    """Blocks of one phrase more in front: the last-to-first step of each shard from its intervals that are alive.

    A string that had `needed` bytes without its last phrase (of `tail` bytes) has been found already, and is left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                phrases, order = np.frombuffer(r["phrases"], np.uint64), np.frombuffer(r["order"], np.int32)
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                lengths = np.frombuffer(r["lengths"], "<u2").astype(np.int64)
                sizes = np.frombuffer(r["sizes"], np.int64)
                rows = np.repeat(np.arange(len(sizes)), sizes)
                low = np.array([x["low"] for x in r["alive"]], np.int64)
                count = np.array([x["high"] for x in r["alive"]], np.int64) - low
                block = np.array([x["block"] for x in r["alive"]], np.int64).view(np.uint64)
                size = np.array([x["bytes"] for x in r["alive"]], np.int64)
                tail = np.array([x["tail"] for x in r["alive"]], np.int64)
                inside = np.repeat(np.arange(len(low)), count)
                places = np.arange(len(inside)) - np.repeat(np.cumsum(count) - count, count) + low[inside]
                here = order[places].astype(np.int64)
                before = here - 1
                fit = (before >= 0) & (rows[np.maximum(before, 0)] == rows[here])  # a text's first phrase has none before
                inside, before = inside[fit], before[fit]
                fit = size[inside] + lengths[before] - tail[inside] < needed
                inside, before = inside[fit], before[fit]
                at = rank[before]
                by = np.argsort(at, kind="stable")
                inside, before, at = inside[by], before[by], at[by]
                name = mixed(phrases[before], block[inside])
                key, lo, hi = intervals_of(name, at)
                first = np.searchsorted(at, lo)
                yield blocks_batch(r["shard"], key, bytes=size[inside[first]] + lengths[before[first]],
                                   tail=tail[inside[first]], low=lo, high=hi)

    own = alive.groupBy("shard").agg(F.collect_list(F.struct("block", "bytes", "tail", "low", "high")).alias("alive"))
    return (shards.select("shard", "order", "phrases", "lengths", "sizes").join(own, "shard")
            .mapInArrow(run, BLOCK_SCHEMA))


def repeated_intervals(shards: DataFrame, rounds: int = ROUNDS, needed: int = NEEDED) -> DataFrame:
    """(shard, low, high) of the intervals of all phrase strings that recur and have `needed` bytes or `rounds` phrases."""
    spark, done, level = shards.sparkSession, None, first_blocks(shards)
    size = F.sum(F.col("high") - F.col("low")).over(Window.partitionBy("block"))  # a block has a row per shard at most
    for k in range(1, rounds + 1):
        recurring = materialise(level.withColumn("n", size).where("n > 1").drop("n"), "recurring")
        release(spark)
        enough = F.col("bytes") >= needed if k < rounds else F.lit(True)
        ready = recurring.where(enough).select("shard", "low", "high")
        done = ready if done is None else done.union(ready)
        level = extended_blocks(shards, recurring, needed)
    return done


def candidates(shards: DataFrame, intervals: DataFrame) -> DataFrame:
    """(row, start, end, core, whole) of every segment whose anchor begins a repeated interval."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                order, widths = np.frombuffer(r["order"], np.int32), np.frombuffer(r["widths"], "<u2").astype(np.int32)
                offsets, lengths = (np.frombuffer(r[c], "<u2").astype(np.int32) for c in ("offsets", "lengths"))
                docs, sizes = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["sizes"], np.int64)
                marked = np.zeros(len(order) + 1, np.int32)
                np.add.at(marked, [x["low"] for x in r["spans"]], 1)
                np.add.at(marked, [x["high"] for x in r["spans"]], -1)
                at = order[np.cumsum(marked[:-1]) > 0]
                at = np.sort(at[widths[at] > 0])
                first = np.cumsum(sizes) - sizes
                # The first segment of a text starts at 0, so its offset is the place of the first anchor.
                before = np.cumsum(lengths.astype(np.int64)) - lengths
                doc = np.repeat(np.arange(len(docs)), sizes)[at]
                start = before[at] - before[first[doc]] + offsets[first[doc]] - offsets[at]
                yield pa.record_batch({"row": docs[doc], "start": start.astype(np.int32), "end": (start + widths[at]).astype(np.int32),
                                       "core": np.frombuffer(r["cores"], np.int64)[at], "whole": np.frombuffer(r["wholes"], np.int64)[at]})

    own = intervals.groupBy("shard").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return (shards.select("shard", "docs", "sizes", "order", "lengths", "offsets", "widths", "cores", "wholes").join(own, "shard")
            .mapInArrow(run, "row bigint, start int, end int, core bigint, whole bigint"))


def window_hashes(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """(row, at, hash) of every window of the segments (row, start, end)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["bytes"], np.uint8)
                spans = np.array(sorted((x["start"], x["end"]) for x in r["spans"]), np.int64)
                first = np.flatnonzero(np.append(True, spans[1:, 0] > spans[:-1, 1]))
                for lo, hi in zip(spans[first, 0], spans[np.append(first[1:], len(spans)) - 1, 1]):
                    for s in range(int(lo), int(hi), PIECE):
                        e = min(s + PIECE, int(hi))
                        h = Hashes(data[s : e - 1 + LENGTH])
                        at = np.arange(e - s)
                        yield pa.record_batch({"row": np.full(e - s, r["row"], np.int64), "at": (at + s).astype(np.int32),
                                               "hash": h.of(at, at + LENGTH).view(np.int64)})

    wanted = segments.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return rows.select("row", "bytes").join(wanted, "row").mapInArrow(run, "row bigint, at int, hash bigint")


RESULT = "row bigint, doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def removed(rows: DataFrame, segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Removal in every row that has repeated segments (row, start, end) or windows (row, at)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                           ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                           ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = r["bytes"]
                found = sorted((x["start"], x["end"] - 1 + LENGTH) for x in r["found"])
                start, end = np.array(found, np.int64).T
                reach = np.maximum.accumulate(end)
                new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                spans = list(zip(start[new].tolist(), reach[np.append(new[1:], len(start)) - 1].tolist()))
                kept, past = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(text[past:s])
                    past = e
                kept.update(text[past:])
                out.append({"row": r["row"], "doc_id": r["doc_id"], "n_bytes": len(text),
                            "n_removed": sum(e - s for s, e in spans), "n_spans": len(spans), "kept_sha256": kept.hexdigest(),
                            "spans": [{"start": s, "end": e} for s, e in spans]})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    both = segments.select("row", "start", "end").union(windows.select("row", F.col("at"), F.col("at") + 1))
    found = both.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    return rows.select("row", "doc_id", "bytes").join(found, "row").mapInArrow(run, RESULT)


def touched_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removal in every row that loses bytes, all rows)."""
    spark = docs.sparkSession
    rows = materialise(numbered(docs), "rows", "zstd")
    shards = materialise(shard_transforms(rows), "shards", "zstd")
    segments = materialise(candidates(shards, repeated_intervals(shards)), "segments")
    release(spark, shards)
    wholes = segments.groupBy("whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("first"))
    cores = segments.groupBy("core").agg(F.min("whole").alias("least"), F.max("whole").alias("most"))
    cores = materialise(cores.where("least <> most").select("core"), "cores")
    copied = materialise(wholes.where("n > 1").select("whole", "first"), "wholes")
    known = materialise(segments.join(copied, "whole", "left"), "known")
    release(spark, segments, copied)
    # Where segments differ but hold the same core, windows are compared: those of one segment of each kind.
    speaks = F.col("first").isNull() | (F.struct("row", "start") == F.col("first"))
    compared = known.where(speaks).join(cores, "core", "left_semi").select("row", "start", "end")
    windows = materialise(window_hashes(rows, compared), "windows")
    release(spark, cores)
    several = materialise(windows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "hashes")
    repeated = materialise(windows.join(several, "hash").select("row", "at"), "repeated")
    release(spark, windows, several)
    touched = removed(rows, known.where("first IS NOT NULL"), repeated)
    return materialise(touched, "removed"), rows


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end in bytes) of every row."""
    touched, rows = touched_rows(docs)
    whole = rows.select("row", "doc_id", "n_bytes", "sha256").join(touched.select("row"), "row", "left_anti").select(
        "doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.col("sha256").alias("kept_sha256"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return touched.drop("row").unionByName(whole)
