"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are added up by cell (a value of each dimension: source, language, topic). Raking scales the cells' weights until
their sums agree with the target share of every value of one dimension, then of the next, and so on in sweeps; the
table of cells is all that the sweeps touch, and each sweep is written to the shared folder. What a cell's weight has been
multiplied by, divided by the largest such factor, is the probability with which each of its documents is taken: never
above 1, and in expectation the sampled tokens have the raked shares. A document is taken if a hash of its doc_id, seen as
a number from 0 to 1, is below the probability, so the choice can be repeated.

One document of a rare source and language has the largest factor of all, and dividing by it would drop most of the others.
With `keep` the factors are scaled so that the sample is expected to hold that share of the tokens at least; cells whose
probability would pass 1 are taken whole, and fall short of their target. With `tolerance` sweeps go on until all sums are
within that share of their targets, or come no closer (then a warning names them).

Targets are given by value, or as an exponent: a value with share s of the tokens gets a target in proportion to s to
that power, below 1 lifting the small ones. Values without a target share the tokens that targets leave, in proportion.

Defined results: null values of a dimension are one value of their own; null and empty texts have one token's weight;
a doc_id draws one number, in whatever rows; a table
without rows gives none; other columns are carried along, and ones named probability or taken are replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwarden.session import materialise

SWEEPS = 10
#: Share of the tokens that the pipeline's mixture keeps at least, and how close its sums come to their targets.
KEEP, TOLERANCE = 0.5, 0.01
POWER = 0.85
NONE = "(none)"
DIMENSIONS = ("source", "lang", "topic")


def tokens(text: str = "text") -> Column:
    """Words of a text, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).cast("bigint")


def topic(text: str = "text") -> Column:
    """A rule by what the text holds: tables, shouting, contacts, figures or prose."""
    return (F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(F.contains(F.col(text), F.lit(" | ")), "table")
            .when(F.contains(F.col(text), F.lit("!!")), "shout").when(F.contains(F.col(text), F.lit("@")), "contact")
            .when(F.col(text).rlike("[0-9]"), "figures").otherwise("prose"))


def unit_hash(column: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the value's text only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def target_shares(cells: DataFrame, dimension: str, targets: dict[str, float] | float) -> DataFrame:
    """(value, target) of every value of a dimension; targets add up to 1."""
    shares = cells.groupBy(dimension).agg(F.sum("n").alias("n"))
    shares = shares.select(dimension, (F.col("n") / cells.agg(F.sum("n")).scalar()).alias("share"))
    if isinstance(targets, dict):
        wanted = F.coalesce(*(F.when(F.col(dimension) == v, F.lit(float(w))) for v, w in sorted(targets.items())), F.lit(None))
        shares = shares.withColumn("wanted", wanted)
        given = shares.agg(F.coalesce(F.sum("wanted"), F.lit(0.0))).scalar()
        others = shares.where("wanted IS NULL").agg(F.sum("share")).scalar()
        raw = F.coalesce("wanted", F.greatest(F.lit(0.0), 1 - given) * F.col("share") / others)
    else:
        raw = F.pow("share", F.lit(float(targets)))
    shares = shares.select(dimension, raw.alias("raw"))
    return shares.select(dimension, (F.col("raw") / shares.agg(F.sum("raw")).scalar()).alias(f"target_{dimension}"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | float], sweeps: int = SWEEPS,
         tolerance: float | None = None) -> DataFrame:
    """The cells with weight: their share of tokens, raked to the targets of every dimension."""
    fitted = cells.withColumn("weight", F.col("n") / cells.agg(F.sum("n")).scalar())
    for dimension, wanted in targets.items():
        fitted = fitted.join(target_shares(cells, dimension, wanted), dimension)
    fitted = materialise(fitted, "cells")
    done, worst = 0, float("inf")
    while done < sweeps or tolerance is not None:
        for dimension in targets:
            total = F.sum("weight").over(Window.partitionBy(dimension))
            fitted = fitted.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"target_{dimension}") / total).otherwise(0.0))
        fitted = materialise(fitted, "cells")
        done += 1
        if tolerance is not None:
            before, worst = worst, off_target(fitted, targets).agg(F.max("off")).first()[0] or 0.0
            if worst <= tolerance:
                break
            if done >= sweeps and worst > 0.99 * before:
                far = off_target(fitted, targets).where(F.col("off") > tolerance).orderBy(F.desc("off")).limit(10).collect()
                warnings.warn("raking cannot meet: " + ", ".join(f"{x.dimension} {x.value} (off by {x.off:.1%})" for x in far), stacklevel=2)
                break
    return fitted


def off_target(fitted: DataFrame, targets: dict[str, dict[str, float] | float]) -> DataFrame:
    """(dimension, value, off): by what share of its target the weight of each value with a target differs from it."""
    out = None
    for k in targets:
        sums = fitted.groupBy(F.col(k).alias("value")).agg(F.sum("weight").alias("weight"), F.first(f"target_{k}").alias("target"))
        one = sums.where("target > 0").select(F.lit(k).alias("dimension"), "value", F.abs(F.col("weight") / F.col("target") - 1).alias("off"))
        out = one if out is None else out.union(one)
    return out


def scale_for(fitted: DataFrame, factor: Column, keep: float) -> float:
    """What factors are multiplied by, so that min(1, factor * scale) keeps a share `keep` of the tokens at least.

    Kept tokens are the least, over all numbers of cells taken whole, of their tokens plus scale times the others' weight.
    """
    order = Window.orderBy(F.desc("factor"))  # one row a cell
    cells = fitted.select("n", "weight", factor.alias("factor"))
    cells = cells.select("factor", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("whole"),
                         F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("others"))
    total = fitted.agg(F.sum("n")).first()[0]
    if not total:
        return 1.0
    wanted = (F.lit(keep * float(total)) - F.coalesce("whole", F.lit(0))) / F.col("others")
    return cells.where("others > 0").agg(F.greatest(F.max(wanted), 1 / F.max("factor"))).first()[0]


def calibrate(docs: DataFrame, targets: dict[str, dict[str, float] | float], seed: int = 4, sweeps: int = SWEEPS,
              keep: float | None = None, tolerance: float | None = None) -> DataFrame:
    """`docs` (with doc_id, n_tokens and a column per dimension) with probability and taken."""
    keys = list(targets)
    named = docs.drop("probability", "taken").withColumns({f"_cell_{k}": F.coalesce(F.col(k).cast("string"), F.lit(NONE)) for k in keys})
    cells = materialise(named.groupBy(*(F.col(f"_cell_{k}").alias(k) for k in keys)).agg(F.sum("n_tokens").alias("n")), "cells")
    fitted = rake(cells, targets, sweeps, tolerance)
    factor = F.col("weight") / F.col("n")
    chance = (factor / fitted.agg(F.max(factor)).scalar() if keep is None
              else F.least(F.lit(1.0), factor * F.lit(scale_for(fitted, factor, keep))))
    odds = fitted.select(*(F.col(k).alias(f"_cell_{k}") for k in keys),
                         chance.alias("probability"))
    odds = materialise(odds, "odds")
    return (named.join(odds, [f"_cell_{k}" for k in keys]).drop(*(f"_cell_{k}" for k in keys))
            .withColumn("taken", unit_hash("doc_id", seed) < F.col("probability")))


def check_sql(power: float = POWER, seed: int = 4, sweeps: int = SWEEPS, documents: str = "documents") -> str:
    """The same probabilities and choices as SQL: doc_id, source, lang, topic, n_tokens, probability, taken."""
    steps = []
    last = "w0"
    for i in range(sweeps):
        for k in DIMENSIONS:
            new = f"w{len(steps) + 1}"
            steps.append(f"{new} AS MATERIALIZED (SELECT * REPLACE (weight * t_{k} / sum(weight) OVER (PARTITION BY {k}) AS weight) "
                         f"FROM {last})")
            last = new
    shares = ", ".join(
        f"s_{k} AS MATERIALIZED (SELECT {k}, r / sum(r) OVER () AS t_{k} FROM (SELECT {k}, "
        f"pow(sum(n) / (SELECT sum(n) FROM cells), {power}) AS r FROM cells GROUP BY {k}))" for k in DIMENSIONS)
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, lang,
         CASE WHEN coalesce(trim(text, ' '), '') = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table'
              WHEN contains(text, '!!') THEN 'shout' WHEN contains(text, '@') THEN 'contact'
              WHEN regexp_matches(text, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
         greatest(1, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0))::BIGINT AS n_tokens
  FROM {documents}),
cells AS MATERIALIZED (
  SELECT coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, topic, sum(n_tokens)::DOUBLE AS n
  FROM d GROUP BY ALL),
{shares},
w0 AS MATERIALIZED (SELECT *, n / (SELECT sum(n) FROM cells) AS weight FROM cells JOIN s_source USING (source)
                    JOIN s_lang USING (lang) JOIN s_topic USING (topic)),
{", ".join(steps)},
odds AS MATERIALIZED (SELECT source, lang, topic, (weight / n) / max(weight / n) OVER () AS p FROM {last})
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p, 9) AS probability,
       CAST('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8) AS BIGINT) / 4294967296.0 < p AS taken
FROM d JOIN odds ON coalesce(d.source, '{NONE}') = odds.source AND coalesce(d.lang, '{NONE}') = odds.lang
  AND d.topic = odds.topic"""
