"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Words are runs of letters and digits in lower case. A seed is a fixed mask laid over consecutive words: it hashes the words
at the marked positions and ignores the others, so a substituted word at an ignored position leaves the hash alone. Seeds of
the benchmark items are joined with the seeds of all texts; every hit names a text, an item and a diagonal (the shift
between their positions). Each distinct diagonal is then verified word by word: the item is laid on the text at that
shift, and a leak is a window of WINDOW words (or the whole item, if shorter) of which SHARE agree.

The masks leave no gap: whichever words of a window of 8 to 20 words are substituted within SHARE, one mask fits between them
(the tests enumerate all patterns). Items of fewer words get masks of their own, made for their length, until every
pattern is met; texts are hashed with these only if the benchmark has items that short.

The seeds of the benchmark are broadcast only if they are few (counted first); otherwise the join shuffles.

Defined results: null and empty texts and items without a word give no rows; items of fewer than `shortest` words are left
out (1: none are); equal texts give a row each, repeated rows (same doc_id) one together; a tie between windows goes to the
one that starts first; empty tables give an empty result; very long texts and items are compared whole; other columns are
not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marked positions are 1. Fixed, since both sides must use the same.
MASKS = ("11111", "1100111", "111010011")
WINDOW, SHARE = 20, 0.8
#: Benchmark seeds that may be broadcast, at most (24 bytes each).
BROADCAST_SEEDS = 1_000_000
WORD = r"[\p{L}\p{N}]+"


def substitutions(length: int, share: float = SHARE) -> list[set[int]]:
    """All sets of as many of `length` places as may differ."""
    return [set(c) for c in itertools.combinations(range(length), length - math.ceil(length * share))]


def hit(mask: str, length: int, substituted: set[int]) -> bool:
    """Whether the mask, somewhere within `length` words, ignores all substituted ones."""
    return any(all(c == "0" or at + k not in substituted for k, c in enumerate(mask)) for at in range(length - len(mask) + 1))


def whole_masks(length: int, masks: tuple[str, ...] = MASKS, share: float = SHARE) -> list[tuple[str, int]]:
    """(mask, first marked place) of further masks, over whole items of `length` words, for the patterns that `masks` miss.

    Patterns share a mask as long as half of the words stay marked.
    """
    missed = [p for p in substitutions(length, share) if not any(hit(m, length, p) for m in masks)]
    out = []
    while missed:
        ignored = set(missed[0])
        for p in missed[1:]:
            if 2 * len(ignored | p) <= length:
                ignored |= p
        missed = [p for p in missed if not p <= ignored]
        mask = "".join("0" if k in ignored else "1" for k in range(length))
        out.append((mask.strip("0"), mask.index("1")))
    return out


def word_hashes(text: str = "text") -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def seed(hashes: str, number: int, mask: str, at: Column) -> Column:
    """(seed, at) of one mask laid on an array of word hashes."""
    marked = [k for k, c in enumerate(mask) if c == "1"]
    return F.struct(F.xxhash64(F.lit(number), *(F.get(hashes, at + k) for k in marked)).alias("seed"), at.cast("int").alias("at"))


def seeds(hashes: str, masks: list[str]) -> Column:
    """Array of (seed, at): the seeds of all masks at all positions of an array of word hashes."""
    def of(number: int, mask: str) -> Column:
        last = F.size(hashes) - len(mask)
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: seed(hashes, number, mask, i))

    return F.concat(*(of(n, m) for n, m in enumerate(masks)))


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW,
          share: float = SHARE, shortest: int = 1) -> DataFrame:
    """(doc_id, item_id, matched, window, start) of every benchmark item of which a text holds enough.

    matched of window words agree in the best window, whose first word is word `start` of the text (from 0).
    """
    items = benchmark.where("text is not null").select("item_id", word_hashes().alias("item_words")).distinct()
    items = items.where(F.size("item_words") >= max(1, shortest))
    n = F.size("item_words")
    short = sorted(r[0] for r in items.where(n <= window).select(n).distinct().collect())  # `window` numbers at most
    extra = [(length, mask, at) for length in short for mask, at in whole_masks(length, masks, share)]
    every = F.inline(F.concat(seeds("item_words", list(masks)), F.filter(F.array(*(
        F.when(n == length, seed("item_words", len(masks) + k, mask, F.lit(at)))
        for k, (length, mask, at) in enumerate(extra))), lambda x: x.isNotNull())) if extra else seeds("item_words", list(masks)))
    item_seeds = items.select("item_id", every.alias("seed", "item_at")).distinct()
    if item_seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        item_seeds = F.broadcast(item_seeds)
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    doc_seeds = (texts.select("doc_id", "text_key", word_hashes().alias("words"))
                 .select("doc_id", "text_key", F.inline(seeds("words", [*masks, *(m for _, m, _ in extra)])).alias("seed", "at")))
    diagonals = (doc_seeds.join(item_seeds, "seed")
                 .select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "item_id",
                         (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    pairs = (diagonals.groupBy("hit_id", "hit_key", "item_id").agg(F.collect_set("shift").alias("shifts")))
    laid = (texts.join(pairs, texts["doc_id"].eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")))
            .select("doc_id", "item_id", "shifts", word_hashes().alias("words"))
            .join(items, "item_id")
            .select("doc_id", "item_id", "words", "item_words", F.least(F.lit(window), F.size("item_words")).alias("window"),
                    F.explode("shifts").alias("shift")))
    agree = F.transform("item_words", lambda w, j: F.when(F.get("words", j + F.col("shift")) == w, 1).otherwise(0))
    sums = F.transform(F.sequence(F.lit(1), F.size("item_words") - F.col("window") + 1), lambda s: F.aggregate(
        F.slice("agree", s, F.col("window")), F.lit(0), lambda a, x: a + x))
    best = F.array_max("sums")
    scored = (laid.withColumn("agree", agree).withColumn("sums", sums)
              .select("doc_id", "item_id", "window", best.alias("matched"),
                      (F.array_position("sums", best).cast("int") - 1 + F.col("shift")).alias("start"))
              .where(F.col("matched") >= F.ceil(F.col("window") * F.lit(share))))
    first = F.max(F.struct("matched", (-F.col("start")).alias("back")))
    return (scored.groupBy("doc_id", "item_id", "window").agg(first.alias("best"))
            .select("doc_id", "item_id", F.col("best.matched").alias("matched"), "window", (-F.col("best.back")).alias("start")))


def check_sql(window: int = WINDOW, share: float = SHARE) -> str:
    """The same result as SQL over the tables documents and benchmark, without masks.

    Where m of w words may differ, some (w - m) / (m + 1) consecutive ones agree, rounded up: items meet texts on such runs.
    """
    tokens = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    win = f"least({window}, len(words))"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {tokens} AS words FROM documents WHERE text IS NOT NULL),
b AS MATERIALIZED (
  SELECT *, CAST(ceil(ceil(win * {share}) / (win - ceil(win * {share}) + 1)) AS BIGINT) AS run
  FROM (SELECT *, {win} AS win FROM (SELECT DISTINCT item_id, {tokens} AS words FROM benchmark WHERE text IS NOT NULL) AS i)
  WHERE win > 0),
bs AS MATERIALIZED (SELECT DISTINCT item_id, run, i AS at, array_to_string(words[i + 1:i + run], ' ') AS seed
                    FROM b, unnest(range(0, len(words) - run + 1)) AS r(i)),
ds AS MATERIALIZED (SELECT k, run, i AS at, array_to_string(words[i + 1:i + run], ' ') AS seed
                    FROM (SELECT k, run, words FROM d CROSS JOIN (SELECT DISTINCT run FROM b) AS runs) AS e,
                         unnest(range(0, len(words) - run + 1)) AS r(i)),
hits AS MATERIALIZED (SELECT DISTINCT ds.k, item_id, ds.at - bs.at AS shift FROM ds JOIN bs USING (run, seed)),
laid AS MATERIALIZED (
  SELECT doc_id, item_id, shift, win, s,
         list_sum([CASE WHEN s + j + shift >= 0 AND d.words[s + j + shift + 1] = b.words[s + j + 1] THEN 1 ELSE 0 END
                   FOR j IN range(0, win)]) AS hit
  FROM hits JOIN d USING (k) JOIN b USING (item_id), unnest(range(0, len(b.words) - win + 1)) AS w(s)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY hit DESC, s + shift) AS r
  FROM laid WHERE hit >= ceil(win * {share}))
SELECT doc_id, item_id, CAST(hit AS INTEGER) AS matched, CAST(win AS INTEGER) AS "window",
       CAST(s + shift AS INTEGER) AS start
FROM ranked WHERE r = 1"""
