"""Notebook corpora: cell sections by manifest, tag or rules; imports, metrics, model family, packages.

Input: cells (notebook, index, cell_type, source), numbered by `index` within their notebook. Work is per cell or aggregated
before a shuffle; a notebook is never gathered into one row, except in pages of bounded size. Ranges of the first manifest
cell travel to the cells as one array per notebook, so the mode of all notebooks takes one aggregation over their cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwarden.functions.patterns import needed_texts
from modelwarden.operators.ordered import SLICE_ROWS, pages, top_per_key

# Tags, rules in order, names, and package names that stored results refer to.
SECTIONS = ["imports", "data-loading", "feature-engineering", "training", "evaluation", "metrics", "config"]
REQUIRED = ["training", "metrics"]
TAG_WORD = "mlops:"
TAG = r"(?md)^\s*#\s*mlops:\s*(\S+)"
MANIFEST_CELL = r"(?md)^\s*#\s*mlops:\s*manifest"
MANIFEST_ENTRY = r"(?md)^\s*#\s*cell\s+(\d+)(?:\s*-\s*(\d+))?\s*:\s*(\S+)"
IMPORT_LINE = r"^\s*(import |from \S+ import )"
SECTION_RULES = [
    ("metrics", 0.9, [
        r"(accuracy_score|f1_score|precision_score|recall_score|roc_auc_score)",
        r"(classification_report|confusion_matrix)",
        r"metrics\s*=\s*\{",
        r"(mean_squared_error|r2_score|mean_absolute_error)",
    ]),
    ("evaluation", 0.85, [
        r"\.(predict|predict_proba|score)\(", r"(y_pred|y_hat|predictions)\s*=", r"model\.evaluate\(",
    ]),
    ("training", 0.9, [r"\.fit\(", r"model\.train\(", r"trainer\.train\(", r"\.compile\(.*optimizer"]),
    ("data-loading", 0.85, [
        r"(pd\.read_csv|pd\.read_parquet|pd\.read_json|pd\.read_sql)",
        r"(load_dataset|fetch_\w+|from_csv)",
        r"(train_test_split|StratifiedKFold)",
        r"(X_train|X_test|y_train|y_test)\s*=",
    ]),
    ("feature-engineering", 0.8, [
        r"(StandardScaler|MinMaxScaler|LabelEncoder|OneHotEncoder)", r"\.transform\(", r"\.fit_transform\(",
        r"(feature_\w+|encode_|normalize_)",
    ]),
    ("config", 0.8, [r"(EPOCHS|BATCH_SIZE|LEARNING_RATE|N_ESTIMATORS)\s*=", r"(hyperparams|config|params)\s*=\s*\{"]),
]
IMPORT_SKIP = ["IPython", "display", "widgets", "matplotlib"]
METRIC_PATTERNS = {
    "accuracy": r"accuracy_score|\.accuracy",
    "f1": r"f1_score",
    "precision": r"precision_score",
    "recall": r"recall_score",
    "auc_roc": r"roc_auc_score|auc",
    "mse": r"mean_squared_error",
    "mae": r"mean_absolute_error",
    "r2": r"r2_score",
}
MODEL_PATTERNS = {
    "random_forest": r"RandomForest(Classifier|Regressor)",
    "xgboost": r"(XGB|xgb)\w*(Classifier|Regressor|\.train)",
    "lightgbm": r"(LGB|lgb)\w*(Classifier|Regressor|\.train)",
    "logistic_regression": r"LogisticRegression",
    "svm": r"(SVC|SVR|LinearSVC)",
    "neural_network": r"(Sequential|nn\.Module|keras\.Model|torch\.nn)",
    "gradient_boosting": r"GradientBoosting(Classifier|Regressor)",
    "linear_regression": r"LinearRegression",
    "decision_tree": r"DecisionTree(Classifier|Regressor)",
}
PACKAGES = {
    "sklearn": "scikit-learn", "cv2": "opencv-python", "PIL": "Pillow", "yaml": "pyyaml", "bs4": "beautifulsoup4",
    "attr": "attrs", "dotenv": "python-dotenv",
}
STDLIB = [
    "os", "sys", "json", "csv", "math", "re", "time", "datetime", "pathlib", "collections", "itertools", "functools",
    "typing", "dataclasses", "abc", "io", "copy", "pickle", "hashlib", "random", "statistics", "logging", "warnings",
    "argparse", "tempfile", "shutil", "glob", "unittest", "contextlib", "enum", "uuid", "struct", "base64", "string",
]


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern is found in a text; texts without any string that the pattern needs skip the regular expression."""
    hit = F.regexp_like(text, F.lit(pattern))
    needs = needed_texts(pattern)
    if not needs:
        return hit
    held = F.contains(text, F.lit(needs[0]))
    for other in needs[1:]:
        held = held | F.contains(text, F.lit(other))
    return held & hit


def rule_cascade(text: Column, rules: Sequence[tuple[str, float, Sequence[str]]], default: str = "unknown") -> Column:
    """Ordered regex rules to a (label, confidence) struct; the first rule with a hit wins."""
    out = F.struct(F.lit(default).alias("label"), F.lit(0.0).alias("confidence"))
    for name, conf, patterns in reversed(list(rules)):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | matches(text, p)
        out = F.when(hit, F.struct(F.lit(name).alias("label"), F.lit(conf).alias("confidence"))).otherwise(out)
    return out


def import_ratio(source: Column) -> Column:
    lines = F.split(source, "\n", -1)
    hits = F.size(F.filter(lines, lambda line: F.regexp_like(line, F.lit(IMPORT_LINE))))
    ratio = hits / F.greatest(F.size(lines), F.lit(1))
    return F.when(F.contains(source, F.lit("import ")), ratio).otherwise(F.lit(0.0))


def classify(source: Column) -> Column:
    """Section and confidence of one cell: mostly import lines first, then the rules."""
    text = _strip(source)
    by_rule = rule_cascade(text, SECTION_RULES)
    imports = F.struct(F.lit("imports").alias("label"), F.lit(0.95).alias("confidence"))
    return F.when(import_ratio(text) > 0.5, imports).otherwise(by_rule)


def code(cells: DataFrame) -> DataFrame:
    return cells.where("cell_type = 'code'")


def tagged_cells(cells: DataFrame) -> DataFrame:
    """Cells whose first tag is a known section, with confidence 1."""
    return code(cells).withColumn("section", _tag()).where(F.col("section").isin(SECTIONS)).withColumn(
        "confidence", F.lit(1.0))


def manifest_ranges(cells: DataFrame) -> DataFrame:
    """(notebook, ranges): the (start, end, section) entries of each notebook's first manifest cell, as written."""
    marked = code(cells).where(F.contains("source", F.lit(TAG_WORD))).where(F.regexp_like("source", F.lit(MANIFEST_CELL))).select("notebook", "index", "source")
    first = top_per_key(marked, ["notebook"], [F.col("index")], 1)

    def part(group: int) -> Column:
        return F.regexp_extract_all("source", F.lit(MANIFEST_ENTRY), F.lit(group))

    def number(digits: Column) -> Column:
        # whole numbers too long for the type are beyond any cell
        return F.least(F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(10**18)), F.lit(10**18)).cast("bigint")

    written = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("t")), lambda e: F.struct(
        number(e["a"]).alias("start"), F.when(e["b"] == "", number(e["a"])).otherwise(number(e["b"])).alias("end"),
        F.lower(e["t"]).alias("section")))
    known = F.filter(written, lambda e: e["section"].isin(SECTIONS) & (e["start"] <= e["end"]))
    return first.select("notebook", known.alias("ranges")).where(F.size("ranges") > 0)


def _listed() -> Column:
    """The manifest entries that name a cell, of the columns `ranges` and `index`."""
    return F.filter("ranges", lambda r: F.col("index").between(r["start"], r["end"]))


def manifest_cells(cells: DataFrame) -> DataFrame:
    """Code cells named by manifest ranges; a cell in two entries appears twice."""
    named = code(cells).join(manifest_ranges(cells), "notebook")
    sections = F.transform(_listed(), lambda r: r["section"])
    return named.withColumn("section", F.explode(sections)).withColumn("confidence", F.lit(1.0)).drop("ranges")


def _inferred() -> Column:
    """Section and confidence of a non-empty cell with a known section, as an array of one; else empty or null."""
    found = F.when(_strip(F.col("source")) != "", F.array(classify(F.col("source"))))
    return F.filter(found, lambda c: c["label"] != "unknown")


def inferred_cells(cells: DataFrame) -> DataFrame:
    """Non-empty code cells with an inferred section; unknown cells are left out."""
    s = code(cells).withColumn("_c", F.explode(_inferred()))
    return s.withColumn("section", F.col("_c.label")).withColumn("confidence", F.col("_c.confidence")).drop("_c")


def _tag() -> Column:
    """The first tag of a cell in lower case, or null."""
    return F.when(F.contains("source", F.lit(TAG_WORD)), F.lower(F.regexp_extract("source", TAG, 1)))


def _bit(section: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(SECTIONS) for x in (name, 1 << i)]), section)


def _mode(manifest: Column, tagged: Column) -> Column:
    return F.when(manifest, "manifest").when(tagged, "blueprint").otherwise("inferred")


def _is_code() -> Column:
    return F.col("cell_type") == "code"


def notebook_modes(cells: DataFrame) -> DataFrame:
    """(notebook, mode): manifest before blueprint (tags) before inferred."""
    return _modes(cells, manifest_ranges(cells))


def _modes(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    named = F.coalesce(F.size(_listed()), F.lit(0)) > 0
    per = cells.join(ranges, "notebook", "left").groupBy("notebook").agg(
        F.bool_or(_is_code() & named).alias("_m"), F.bool_or(_is_code() & _tag().isin(SECTIONS)).alias("_t"))
    return per.select("notebook", _mode(F.col("_m"), F.col("_t")).alias("mode"))


def section_cells(cells: DataFrame) -> DataFrame:
    """(notebook, mode, section, index, confidence, source) in each notebook's mode.

    Cells are read for the ranges, the modes and the sections; only cells of inferred notebooks go through the rules.
    """
    ranges = manifest_ranges(cells)
    placed = code(cells).join(_modes(cells, ranges), "notebook").join(ranges, "notebook", "left")

    def sure(section: Column) -> Column:
        return F.struct(section.alias("label"), F.lit(1.0).alias("confidence"))

    mine = (F.when(F.col("mode") == "manifest", F.transform(_listed(), lambda r: sure(r["section"])))
            .when(F.col("mode") == "blueprint", F.filter(F.array(sure(_tag())), lambda c: c["label"].isin(SECTIONS)))
            .otherwise(_inferred()))
    found = placed.withColumn("_c", F.explode(mine))
    return found.select("notebook", "mode", "index", F.col("_c.label").alias("section"),
                        F.col("_c.confidence").alias("confidence"), "source")


def section_confidence(sections: DataFrame) -> DataFrame:
    """Cells, mean confidence and level per notebook and section."""
    out = sections.groupBy("notebook", "mode", "section").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("confidence").alias("avg_confidence"))
    level = F.when(F.col("avg_confidence") >= 0.9, "high").when(F.col("avg_confidence") >= 0.8, "medium").otherwise("low")
    return out.withColumn("level", level)


def _usage() -> tuple[Column, Column]:
    """Metric names used by a cell, as bits in the order of the patterns, and the rank of its model family.

    No pattern spans a line break, so matching cell by cell equals matching the whole code.
    """
    src = F.col("source")
    used = F.lit(0)
    for i, p in enumerate(METRIC_PATTERNS.values()):
        used = used.bitwiseOR(F.when(matches(src, p), 1 << i).otherwise(0))
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(MODEL_PATTERNS.values()))):
        rank = F.when(matches(src, p), F.lit(i)).otherwise(rank)
    return used, rank


def _names(bits: Column, names: Sequence[str]) -> Column:
    """The names whose bits are set, in their order."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names)]))


def code_usage(cells: DataFrame) -> DataFrame:
    """Metric names used and model family per notebook with code."""
    return structures(code(cells)).select("notebook", "metrics", "model_type")


def structures(cells: DataFrame) -> DataFrame:
    """One row per notebook: mode, sections found, required sections missing, metrics, model family.

    One aggregation over the cells: what each mode would find is kept as bits, and the mode picks among them.
    """
    is_code = _is_code()
    none = F.lit(0)
    listed = F.aggregate(F.coalesce(_listed(), F.array().cast("array<struct<start:bigint,end:bigint,section:string>>")),
                         none, lambda a, r: a.bitwiseOR(_bit(r["section"])))
    used, rank = _usage()
    # a model family or a metric is found in code cells only, as are sections
    facts = cells.join(manifest_ranges(cells), "notebook", "left").select(
        "notebook", F.when(is_code, listed).otherwise(none).alias("_m"),
        F.when(is_code, F.coalesce(_bit(_tag()), none)).otherwise(none).alias("_t"),
        F.when(is_code, F.coalesce(_bit(F.get(_inferred(), F.lit(0))["label"]), none)).otherwise(none).alias("_i"),
        F.when(is_code, used).otherwise(none).alias("_used"), F.when(is_code, rank).alias("_rank"))
    per = facts.groupBy("notebook").agg(*[F.bit_or(c).alias(c) for c in ("_m", "_t", "_i", "_used")], F.min("_rank").alias("_rank"))
    mode = _mode(F.col("_m") != 0, F.col("_t") != 0)
    bits = F.when(F.col("_m") != 0, F.col("_m")).when(F.col("_t") != 0, F.col("_t")).otherwise(F.col("_i"))
    family = F.coalesce(F.get(F.array(*[F.lit(n) for n in MODEL_PATTERNS]), F.col("_rank")), F.lit("unknown"))
    out = per.select("notebook", mode.alias("mode"), F.array_sort(_names(bits, SECTIONS)).alias("sections"),
                     _names(F.col("_used"), list(METRIC_PATTERNS)).alias("metrics"), family.alias("model_type"))
    missing = F.array_except(F.array(*[F.lit(r) for r in REQUIRED]), F.col("sections"))
    return out.select("notebook", "mode", "sections", missing.alias("missing_sections"), "metrics", "model_type")


def mode_warnings(structure: DataFrame) -> DataFrame:
    """Notebook-level warnings (notebook, warning)."""
    missing = F.size("missing_sections") > 0
    tagged = F.when(missing, F.concat(F.lit("Missing required sections: "), F.array_join("missing_sections", ", ")))
    untagged = F.array_compact(F.array(
        F.lit("No # mlops: tags found. Structure inferred from code patterns."),
        F.when(F.array_contains("missing_sections", "training"),
               F.lit("  Could not detect training logic - add # mlops: training tag")),
        F.when(F.array_contains("missing_sections", "metrics"),
               F.lit("  Could not detect metrics - add # mlops: metrics tag")),
    ))
    lines = F.when(F.col("mode") == "inferred", untagged).otherwise(F.array_compact(F.array(tagged)))
    return structure.select("notebook", F.explode(lines).alias("warning"))


def section_warnings(sections: DataFrame, page_cells: int = 1000, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Confidence notes of inferred sections with their cell numbers, in pages of at most page_cells."""
    mine = sections.where("mode = 'inferred'").select("notebook", "section", "index")
    paged = pages(mine, ["notebook", "section"], ["index"], page_cells, slice_rows=slice_rows)
    listed = paged.groupBy("notebook", "section", "page").agg(F.array_sort(F.collect_list("index")).alias("_i"))
    levels = section_confidence(sections.where("mode = 'inferred'")).select("notebook", "section", "level")
    text = F.concat(F.lit("  "), "section", F.lit(": cells "), F.array_join("_i", ","), F.lit(" (confidence: "),
                    "level", F.lit(")"))
    return listed.join(levels, ["notebook", "section"]).select("notebook", "section", "page", text.alias("warning"))


def section_code(sections: DataFrame, page_cells: int = 1000, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Code of each section in cell order, a blank line between cells, in pages of at most page_cells."""
    rows = sections.select("notebook", "section", "index", "source")
    paged = pages(rows, ["notebook", "section"], ["index", "source"], page_cells, slice_rows=slice_rows)
    ordered = F.array_sort(F.collect_list(F.struct("position", "source")))
    return paged.groupBy("notebook", "section", "page").agg(
        F.array_join(F.transform(ordered, lambda x: x["source"]), "\n\n").alias("code"))


def import_lines(cells: DataFrame) -> DataFrame:
    """Distinct import statements (notebook, line), without notebook-only modules."""
    lines = code(cells).select("notebook", F.explode(F.split("source", "\n", -1)).alias("line"))
    lines = lines.withColumn("line", _strip(F.col("line")))
    keep = F.startswith("line", F.lit("import ")) | F.startswith("line", F.lit("from "))
    for word in IMPORT_SKIP:
        keep = keep & ~F.contains("line", F.lit(word))
    return lines.where(keep).distinct()


def requirements(cells: DataFrame) -> DataFrame:
    """Packages per notebook (notebook, package): import roots without the standard library, renamed."""
    module = F.regexp_extract("line", r"^(?:from|import)\s+(\S+)", 1)
    root = F.split_part(module, F.lit("."), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in PACKAGES.items() for x in kv])
    rows = import_lines(cells).withColumn("_root", root).where((F.col("_root") != "") & ~F.col("_root").isin(STDLIB))
    return rows.select("notebook", F.coalesce(F.try_element_at(table, F.col("_root")), "_root").alias("package")).distinct()
