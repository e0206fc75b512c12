"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts character 1-, 2- and 3-grams of whole texts per language into hash buckets, inside each task and then
across tasks. The matrix of log-probabilities (languages x buckets) goes to all tasks as a broadcast; texts are scored in
batches with numpy. A broadcast holds BLOCK languages at most (64 MB). More languages are scored in rounds, one block each;
every round keeps a text's best language so far and the sum that its posterior is taken from.

Defined results: a null text, an empty text and a text without a letter give `und` with score 0; rows with null
`lang` teach nothing; with nothing learned every text gives `und`; equal scores go to the language first in text order;
repeated rows are scored each; other columns are passed by unread. Very long texts are scored whole, in slices.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from modelwarden.llm.common import byte_sizes, chunks
from modelwarden.session import materialise

#: Blocks of languages in text order: their names and the log-probabilities of the buckets.
Model = list[tuple[list[str], np.ndarray]]

BUCKETS = 1 << 16
#: Characters handled at a time inside a task.
SLICE = 1 << 20
#: Languages learned and scored together: 64 MB of log-probabilities, and as much in a training task.
BLOCK = 128
SPACE = 32


@cache
def folding() -> np.ndarray:
    """Lower case of every letter by code point; whatever is no letter becomes a space."""
    out = np.full(sys.maxunicode + 1, SPACE, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def gram_buckets(points: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each position; two spaces must end `points`."""
    one = points * np.uint32(0x9E3779B1)
    a, b, c = one[:-2], one[1:-1], one[2:]
    two = (a ^ (b >> np.uint32(7))) * np.uint32(0x85EBCA77)
    three = (two ^ (c >> np.uint32(5))) * np.uint32(0xC2B2AE3D)
    shift = np.uint32(16)
    return [a >> shift, two >> shift, three >> shift]


@cache
def blank_buckets() -> tuple[int, ...]:
    """Buckets of the n-grams that are all spaces, which say nothing."""
    return tuple(int(g[0]) for g in gram_buckets(np.full(3, SPACE, np.uint32)))


def slices(texts: list[str | None]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(buckets of the 1-, 2- and 3-grams that start in a text, text index of each, whether a letter stands there).

    Spaces end every text, so no gram reaches into the next one; grams that start at those spaces are left out.
    """
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], dtype=np.int64)
    gap = np.full(2, SPACE, np.uint32)
    joined = folding()[np.concatenate([np.zeros(0, np.uint32), *(x for p in points for x in (p, gap))])]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + len(gap))
    inside = np.ones(len(joined), bool)
    ends = np.cumsum(sizes + len(gap))
    inside[ends - 1] = inside[ends - 2] = False
    for start in range(0, len(joined), SLICE):
        own, starts = owner[start : start + SLICE], inside[start : start + SLICE]
        part = joined[start : start + SLICE + 2]
        full = np.concatenate([part, gap[: len(own) + 2 - len(part)]])
        yield [g[starts] for g in gram_buckets(full)], own[starts], part[: len(own)][starts] != SPACE


def training_counts(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, bucket, n): n-gram counts over all rows with columns text and lang.

    A task holds the tables of `block` languages at most and passes them on when another comes.
    """

    def emit(tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in tables.items():
            counts[list(blank_buckets())] = 0
            used = np.flatnonzero(counts)
            yield pa.record_batch({"lang": pa.array([name] * len(used), pa.string()), "bucket": used.astype(np.int32),
                                   "n": counts[used]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang").to_pylist()
            for lo, hi in chunks(byte_sizes(texts), SLICE):
                names, which = np.unique(np.array(langs[lo:hi], dtype=object).astype(str), return_inverse=True)
                for first in range(0, len(names), block):
                    mine = names[first : first + block]
                    if len(tables.keys() | set(map(str, mine))) > block:
                        yield from emit(tables)
                        tables = {}
                    picked = np.flatnonzero((which >= first) & (which < first + block))
                    for grams, own, _ in slices(texts[lo:hi].take(pa.array(picked)).to_pylist()):
                        base = (which[picked] - first)[own].astype(np.int64) * BUCKETS
                        total = sum(np.bincount(base + g, minlength=len(mine) * BUCKETS) for g in grams)
                        for k, name in enumerate(mine):
                            kept = tables.setdefault(str(name), np.zeros(BUCKETS, np.int64))
                            kept += total[k * BUCKETS : (k + 1) * BUCKETS]
        yield from emit(tables)

    known = rows.where(F.col("lang").isNotNull()).select("text", "lang")
    parts = known.mapInArrow(count, "lang string, bucket int, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, smoothing: float = 0.5, block: int = BLOCK) -> Model:
    """Log-probabilities of buckets by language, learned from the rows' text and lang, in blocks of languages."""
    counts = training_counts(rows, block)
    several = rows.select("lang").where("lang is not null").distinct().limit(block + 1).count() > block
    if not several:
        return [log_probabilities(counts, smoothing)]
    counts = materialise(counts, "gram-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    parts = [langs[i : i + block] for i in range(0, len(langs), block)]
    return [log_probabilities(counts.where(F.col("lang").between(part[0], part[-1])), smoothing) for part in parts]


def log_probabilities(table_rows: DataFrame, smoothing: float) -> tuple[list[str], np.ndarray]:
    counts = table_rows.toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((len(langs), BUCKETS))
    at = {x: i for i, x in enumerate(langs)}
    rowno = np.array([at[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
    table[rowno, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    table += smoothing
    logs = np.log(table) - np.log(table.sum(axis=1, keepdims=True)) if langs else table
    logs[:, list(blank_buckets())] = 0
    return langs, logs


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row, with lang_pred and score (the posterior probability of lang_pred)."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), "text", F.lit("und").alias("best"), F.lit(None).cast("double").alias("total"),
                       F.lit(0.0).alias("others"))
    for number, block in enumerate(model):
        last = number == len(model) - 1
        rows = score_block(rows, block, last)
        if not last:
            rows = materialise(rows, "language-round")
    return rows.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)), F.col("best").alias("lang_pred"),
                       F.when(F.col("total").isNull(), 0.0).otherwise(1 / F.col("others")).alias("score"))


def score_block(rows: DataFrame, block: tuple[list[str], np.ndarray], last: bool) -> DataFrame:
    """The rows with their best language so far: `total` is its log-probability, `others` the sum of exp(any - total).

    A text without a letter keeps a null total. Texts are passed on but for the last block.
    """
    langs, logs = block
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    kept = [f for f in rows.schema.fields if not last or f.name != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = batch.column("text")
            names, totals, sums = batch.column("best").to_pylist(), [], []
            before = batch.column("total").to_numpy(zero_copy_only=False)
            rest = batch.column("others").to_numpy(zero_copy_only=False)
            for lo, hi in chunks(byte_sizes(texts), SLICE):
                found = np.zeros((len(langs), hi - lo))
                letters = np.zeros(hi - lo, np.int64)
                for grams, own, is_letter in slices(texts[lo:hi].to_pylist()):
                    letters += np.bincount(own, weights=is_letter, minlength=hi - lo).astype(np.int64)
                    for k in range(len(langs)):
                        found[k] += np.bincount(own, weights=sum(table[k][g] for g in grams), minlength=hi - lo)
                known = (letters > 0) & bool(langs)
                held = np.where(np.isnan(before[lo:hi]), -np.inf, before[lo:hi])
                top = np.maximum(held, found.max(axis=0)) if langs else held
                safe = np.where(known, top, 0.0)
                total = np.exp(found - safe).sum(axis=0) + np.where(np.isfinite(held), rest[lo:hi] * np.exp(held - safe), 0.0)
                first = found.argmax(axis=0) if langs else np.zeros(hi - lo, np.int64)
                for i in np.flatnonzero(known & (top > held)):
                    names[lo + i] = langs[int(first[i])]
                totals.append(np.where(known, top, np.nan))
                sums.append(total)
            new = {"best": pa.array(names, pa.string()),
                   "total": pa.array(np.concatenate([*totals, np.zeros(0)]), from_pandas=True),
                   "others": pa.array(np.concatenate([*sums, np.zeros(0)]))}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name) for f in kept],
                                             names=[f.name for f in kept])

    return rows.mapInArrow(score, StructType(kept))


def identify(docs: DataFrame, training: DataFrame, keep: list[str]) -> DataFrame:
    """Language of every row of `docs`, learned from `training` (columns text and lang)."""
    return predict(docs, fit(training), keep)
