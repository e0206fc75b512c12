"""Dataset quality: null rates, schema changes, validation reports, and drift (PSI, two-sample KS)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwarden.operators.ordered import SLICE_ROWS, scan

SHARE_FLOOR = 1e-6


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_rate) for all columns from one aggregation over one scan."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "null_rate")


def null_rate_map(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: row count and the map column -> null rate."""
    columns = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("num_rows"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"_{c}") for c in columns]
    )
    pairs = [x for c in columns for x in (F.lit(c), F.coalesce(F.col(f"_{c}"), F.lit(0.0)))]
    return wide.select("num_rows", F.create_map(*pairs).alias("null_rates"))


def schema_rows(df: DataFrame) -> DataFrame:
    """(column, type) rows of a DataFrame's own schema."""
    pairs = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(pairs, "column string, type string")


def observed_schema(records: DataFrame, field: str, type_: str, keys: Sequence[str] = ()) -> DataFrame:
    """Schema seen in (field, type) observations; conflicting types are listed together."""
    return records.groupBy(*keys, F.col(field).alias("column")).agg(
        F.array_join(F.array_sort(F.collect_set(type_)), "|").alias("type")
    )


def schema_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Added, removed and retyped columns between two (keys, column, type) tables."""
    on = [*keys, "column"]
    both = old.withColumnRenamed("type", "old_type").join(new.withColumnRenamed("type", "new_type"), on, "full")
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
    )
    text = (
        F.when(F.col("change") == "added", F.concat(F.lit("added column "), "column"))
        .when(F.col("change") == "removed", F.concat(F.lit("removed column "), "column"))
        .otherwise(F.concat(F.lit("changed type of "), "column", F.lit(": "), "old_type", F.lit(" -> "), "new_type"))
    )
    return both.withColumn("change", change).where("change IS NOT NULL").withColumn("description", text)


def report_summary(checks: DataFrame, keys: Sequence[str], passed: Column, label: str, show: int = 5) -> DataFrame:
    """Validation checks to one report row per key: totals, pass rate, first failures.

    Only the first `show` failure labels are listed; the counts cover every check.
    """
    from modelwarden.operators.ordered import top_per_key

    marked = checks.withColumn("_ok", F.coalesce(passed, F.lit(False)))
    totals = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if("_ok").alias("passed_checks")
    )
    failures = (
        top_per_key(marked.where("NOT _ok").select(*keys, label).distinct(), keys, [F.asc(label)], show)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(label)).alias("failed_checks"))
    )
    return totals.join(failures, list(keys), "left").withColumn(
        "failed_checks", F.coalesce("failed_checks", F.array().cast("array<string>"))
    )


def numeric_observations(
    df: DataFrame, features: Sequence[str], is_base: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Long form (keys, feature, value, is_base) of numeric columns, NULLs left out, from one scan."""
    wide = df.select(*keys, is_base.alias("is_base"), *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot([*keys, "is_base"], list(features), "feature", "value").where("value IS NOT NULL")


def _value_counts(obs: DataFrame, by: list[str], value: str) -> DataFrame:
    return obs.groupBy(*by, value).agg(
        F.count_if("is_base").alias("n_base"), F.count_if(~F.col("is_base")).alias("n_cur")
    )


def _share(n: Column, total: Column) -> Column:
    return F.greatest(F.coalesce(F.try_divide(n, total), F.lit(0.0)), F.lit(SHARE_FLOOR))


def _index_term(a: Column, e: Column) -> Column:
    return (a - e) * F.ln(a / e)


def drift_profile(
    obs: DataFrame, keys: Sequence[str] = (), bins: int = 10, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """PSI and two-sample KS per (keys, feature) from one set of cumulative value counts.

    obs: (keys, feature, value, is_base). PSI bins are the baseline's exact quantile bins; a share is
    floored at 1e-6; natural log. KS: D = max |F_base - F_current|, p from the asymptotic series with
    lambda = (sqrt(ne) + 0.12 + 0.11 / sqrt(ne)) * D, ne = n m / (n + m).
    Values are counted before any sort, and long features are cumulated in slices.
    """
    by = [*keys, "feature"]
    counts = _value_counts(obs, by, "value")
    cum = scan(counts, by, ["value"], sums={"cb": "n_base", "cc": "n_cur"}, totals={"nb": "n_base", "nc": "n_cur"},
               slice_rows=slice_rows)
    below = F.col("cb") - F.col("n_base")
    per_bin = (
        cum
        # value > k-th quantile  <=>  baseline rows below it >= k * nb / bins
        .withColumn("bin", F.least(F.lit(bins - 1), F.floor(below * bins / F.greatest("nb", F.lit(1)))))
        .withColumn("gap", F.abs(F.try_divide("cb", "nb") - F.try_divide("cc", "nc")))
        .groupBy(*by, "bin")
        .agg(
            F.sum("n_base").alias("n_base"), F.sum("n_cur").alias("n_cur"), F.max("gap").alias("gap"),
            F.first("nb").alias("nb"), F.first("nc").alias("nc"),
        )
    )
    a, e = _share(F.col("n_cur"), F.col("nc")), _share(F.col("n_base"), F.col("nb"))
    out = per_bin.groupBy(*by).agg(
        F.first("nb").alias("n_base"), F.first("nc").alias("n_cur"),
        F.sum(_index_term(a, e)).alias("psi"), F.max("gap").alias("ks_d"),
    )
    both = (F.col("n_base") > 0) & (F.col("n_cur") > 0)
    return out.withColumn("psi", F.when(both, F.col("psi"))).withColumn(
        "ks_p", F.when(both, ks_p_value(F.col("ks_d"), F.col("n_base"), F.col("n_cur")))
    )


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    ne = n * m / (n + m)
    lam = (F.sqrt(ne) + 0.12 + 0.11 / F.sqrt(ne)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam),
    )
    return F.when(lam < 0.05, F.lit(1.0)).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def psi_categorical(obs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """PSI over categories: (keys, feature, value string, is_base) -> (keys, feature, psi)."""
    by = [*keys, "feature"]
    counts = _value_counts(obs, by, "value")
    totals = counts.groupBy(*by).agg(F.sum("n_base").alias("nb"), F.sum("n_cur").alias("nc"))
    a, e = _share(F.col("n_cur"), F.col("nc")), _share(F.col("n_base"), F.col("nb"))
    return (
        counts.join(totals, by).groupBy(*by)
        .agg(F.sum(_index_term(a, e)).alias("psi"), F.first("nb").alias("n_base"), F.first("nc").alias("n_cur"))
    )


def baseline_edges(df: DataFrame, features: Sequence[str], bins: int = 10, k: int = 4096, salts: int = 256) -> DataFrame:
    """Quantile edges per feature from mergeable sketches: (feature, edges). Save them with the baseline.

    Sketches are built per task, merged per salt and then together, so no task merges one sketch per
    input split. Exact while a feature has no more than about k values; k is at most 65535.
    """
    wide = df.select((F.spark_partition_id() % salts).alias("_salt"), *[F.col(f).cast("double").alias(f) for f in features])
    first = wide.groupBy("_salt").agg(*[F.kll_sketch_agg_double(f, k).alias(f) for f in features])
    merged = first.agg(*[F.kll_merge_agg_double(f, k).alias(f) for f in features])
    probs = [i / bins for i in range(1, bins)]
    arrays = merged.select(
        *[F.array(*[F.kll_sketch_get_quantile_double(F.col(f), F.lit(p)) for p in probs]).alias(f) for f in features]
    )
    return arrays.unpivot([], list(features), "feature", "edges")


def exact_edges(df: DataFrame, features: Sequence[str], bins: int = 10, cells: int = 512) -> DataFrame:
    """(feature, edges): the exact discrete quantiles of finite values, by selection in rounds of one scan each.

    The first round takes counts and a sketch, which brackets every quantile. Every other round counts the values below, between
    and in the brackets, the latter in `cells` equal parts with the least and greatest value of each. The part that holds
    the wanted rank is the next bracket, until it holds a single value; a rank outside its bracket widens it. A round
    shuffles at most (2 + cells) rows per bracket and task, however many values there are; the number of rounds grows with the
    logarithm of a bracket's spread, two or three as a rule. NULL is no value; a feature without values has no row.
    """
    probs = [i / bins for i in range(1, bins)]
    wide = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    sketched = wide.agg(*[F.struct(F.count(f).alias("n"), F.min(f).alias("low"), F.max(f).alias("high"),
                                   F.kll_sketch_agg_double(f, F.lit(4096)).alias("k")).alias(f) for f in features])
    near = [0.0 if p < 0.002 else p - 0.002 for p in probs], [min(p + 0.002, 1.0) for p in probs]
    first = sketched.select(*[F.struct(f"{f}.n", f"{f}.low", f"{f}.high", *[
        F.when(F.col(f)["n"] > 0, F.array(*[F.kll_sketch_get_quantile_double(F.col(f)["k"], F.lit(p)) for p in side])).alias(name)
        for name, side in zip(("from", "to"), near)]).alias(f) for f in features]).first()
    todo: dict[str, dict[int, tuple[float, float]]] = {}  # feature -> rank -> bracket
    done: dict[str, dict[int, float]] = {f: {} for f in features}
    ranks: dict[str, list[int]] = {}
    for f in features:
        if first[f].n:
            ranks[f] = [max(-(-i * first[f].n // bins), 1) for i in range(1, bins)]
            todo[f] = dict(zip(ranks[f], zip(first[f]["from"], first[f]["to"])))
    while any(todo.values()):
        merged = {f: _disjoint(brackets.values()) for f, brackets in todo.items() if brackets}
        for f, found in _cell_counts(wide, merged, cells).items():
            passed, at = 0, 0
            for rank in sorted(todo[f]):
                while passed + found[at][0] < rank:
                    passed, at = passed + found[at][0], at + 1
                _, low, high = found[at]
                todo[f][rank] = (low, high)
                if low == high:
                    done[f][rank] = todo[f].pop(rank)[0]
    rows = [(f, [done[f][r] for r in ranks[f]]) for f in features if f in ranks]
    return df.sparkSession.createDataFrame(rows, "feature string, edges array<double>")


def _disjoint(brackets) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(set(brackets)):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _cell_counts(wide: DataFrame, brackets: dict[str, list[tuple[float, float]]], cells: int) -> dict[str, list[tuple]]:
    """feature -> (count, least, greatest) of the values between the brackets and in the parts of each, in order of the values."""

    names = list(brackets)
    # Places from 0 on, odd ones inside a bracket: a sum of comparisons, which compiles to less than a chain of cases.
    items = ", ".join("named_struct('f', {}, 'v', `{}`, 's', {})".format(i, f, " + ".join(
        f"CAST(`{f}` >= {low!r}D AS INT) + CAST(`{f}` > {high!r}D AS INT)" for low, high in brackets[f])) for i, f in enumerate(names))
    parts = ""
    for i, f in enumerate(names):
        for j, (low, high) in enumerate(brackets[f]):
            if low < high:
                # Halved where the width itself would overflow. The two ends are never in one part, so a bracket always narrows.
                h = 2 if math.isinf(high - low) else 1
                parts += (f" WHEN f = {i} AND s = {2 * j + 1} THEN least({cells - 1}, CAST(floor((v / {h} - {low / h!r}D) / "
                          f"{high / h - low / h!r}D * {cells}) AS INT))")
    rows = wide.selectExpr(f"inline(array({items}))").where("v IS NOT NULL")
    rows = rows.select("f", "s", "v", F.expr(f"CASE{parts} ELSE 0 END" if parts else "0").alias("p"))
    counted = rows.groupBy("f", "s", "p").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    found: dict[str, list[tuple]] = {}
    for r in counted.orderBy("f", "s", "p").collect():  # at most (2 + cells) rows per bracket
        found.setdefault(names[r.f], []).append((r.n, r.low, r.high))
    return found


def psi_from_edges(obs: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """PSI against stored edges: one pass with a tiny shuffle of bin counts. Reads the edges, a row per feature, when built."""
    bins = "".join(
        " WHEN {} THEN {}".format(_quoted(r.feature), " + ".join(f"CAST(coalesce(value > {e!r}D, FALSE) AS INT)" for e in r.edges) or "0")
        for r in edges.select("feature", "edges").collect())
    binned = obs.withColumn("value", F.expr(f"CASE feature{bins} END") if bins else F.lit(None).cast("int"))
    return psi_categorical(binned.where("value IS NOT NULL"), keys)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def drift_maps(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per subject: maps feature -> PSI and feature -> KS p-value, as the gates take them."""
    scored = profile.where("psi IS NOT NULL")
    return scored.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "psi"))).alias("psi_scores"),
        F.map_from_entries(F.collect_list(F.struct("feature", "ks_p"))).alias("ks_p_values"),
    )


def drift_summary(profile: DataFrame, keys: Sequence[str], max_psi: float = 0.2, min_p: float = 0.01) -> DataFrame:
    """Drifted and total feature counts, worst PSI, names of drifted features, significant KS tests."""
    drifted = F.col("psi") > max_psi
    return profile.groupBy(*keys).agg(
        F.count_if(drifted).alias("drifted_count"),
        F.count(F.lit(1)).alias("total_features"),
        F.max("psi").alias("max_psi"),
        F.array_sort(F.collect_list(F.when(drifted, F.col("feature")))).alias("drifted_features"),
        F.count_if(F.col("ks_p") < min_p).alias("significant_features"),
    )
