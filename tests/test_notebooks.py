import pytest
from pyspark.sql import functions as F

from modelwarden.operators import notebooks as nb


def cells(spark, *books):
    rows = [(name, i, c[0] if isinstance(c, tuple) else "code", c[1] if isinstance(c, tuple) else c)
            for name, cs in books for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "notebook string, index bigint, cell_type string, source string")


@pytest.mark.parametrize("source,section,confidence", [
    ("model.fit(X, y)", "training", 0.9), ("import os\nimport sys\nx = 1", "imports", 0.95), ("import os\nx = 1", "unknown", 0.0),
    ("y_pred = f(x)", "evaluation", 0.85), ("f1_score(model.predict(X))", "metrics", 0.9), ("df = pd.read_csv('x')", "data-loading", 0.85),
    ("s = StandardScaler()", "feature-engineering", 0.8), ("params = {", "config", 0.8), ("print('hi')", "unknown", 0.0),
    ("m.compile(a,\noptimizer)", "unknown", 0.0)])
def test_classify(spark, source, section, confidence):
    r = spark.createDataFrame([(source,)], "s string").select(nb.classify(F.col("s")).alias("c")).first().c
    assert (r.label, r.confidence) == (section, confidence)


def test_tags(spark, rows):
    df = cells(spark, ("n", ["# mlops: imports\nimport a", "# mlops: Data-Loading\nx", "# mlops: nope\n# mlops: training", ("markdown", "# mlops: metrics"),
                             "x\n  #mlops: metrics"]))
    assert rows(nb.tagged_cells(df), "index", "section") == [(0, "imports"), (1, "data-loading"), (4, "metrics")]


def test_manifest(spark, rows):
    df = cells(spark, ("n", ["x = 1", "model = RF()", "model.fit(X, y)", ("markdown", "t"),
                             "# mlops: manifest\n# cell 1-2: training\n# cell 3: evaluation\n# cell 4 - 99999999999999999999: config\n# cell 2: metrics\n# cell 7: imports\n# cell 2-1: config",
                             "# mlops: manifest\n# cell 0: imports"]))
    assert rows(nb.manifest_cells(df), "index", "section") == [
        (1, "training"), (2, "metrics"), (2, "training"), (4, "config"), (5, "config")]


def test_structures(spark):
    df = cells(
        spark,
        ("m", ["# mlops: imports\nimport pandas", "model.fit(X, y)", "# mlops: manifest\n# cell 1: training"]),
        ("b", ["# mlops: training\nmodel.fit(X, y)", "# mlops: metrics\nmetrics = {'f1': 0.9}"]),
        ("i", ["RandomForestClassifier().fit(X, y)", "x = xgb.train(p)", "roc_auc_score(y, p)"]),
        ("e", [("markdown", "only text")]))
    out = {r.notebook: r for r in nb.structures(df).collect()}
    assert {k: (r.mode, r.sections, r.missing_sections, r.model_type) for k, r in out.items()} == {
        "m": ("manifest", ["training"], ["metrics"], "unknown"), "b": ("blueprint", ["metrics", "training"], [], "unknown"),
        "i": ("inferred", ["metrics", "training"], [], "random_forest"),
        "e": ("inferred", [], ["training", "metrics"], "unknown")}
    assert out["i"].metrics == ["auc_roc"]
    w = {}
    for r in nb.mode_warnings(nb.structures(df)).collect():
        w.setdefault(r.notebook, []).append(r.warning)
    assert w["m"] == ["Missing required sections: metrics"] and "b" not in w and len(w["e"]) == 3
    notes = nb.section_warnings(nb.section_cells(df)).collect()
    assert {r.warning for r in notes} == {"  training: cells 0 (confidence: high)", "  metrics: cells 2 (confidence: high)"}


def test_section_code_pages(spark):
    df = cells(spark, ("n", [f"# mlops: training\nstep{i}.fit()" for i in range(25)]))
    sections = nb.section_cells(df)
    assert nb.section_code(sections).first().code == "\n\n".join(f"# mlops: training\nstep{i}.fit()" for i in range(25))
    paged = sorted(nb.section_code(sections, 10, slice_rows=4).collect(), key=lambda r: r.page)
    assert len(paged) == 3 and "\n\n".join(r.code for r in paged) == nb.section_code(sections).first().code


def test_imports(spark, rows):
    df = cells(spark, ("n", ["import pandas as pd\nfrom IPython.display import x\nimport matplotlib.pyplot\n  import yaml", "import yaml\nimport os\nfrom sklearn.svm import SVC",
                             ("markdown", "import torch")]))
    assert rows(nb.import_lines(df), "line") == [("from sklearn.svm import SVC",), ("import os",), ("import pandas as pd",), ("import yaml",)]
    assert rows(nb.requirements(df), "package") == [("pandas",), ("pyyaml",), ("scikit-learn",)]


def test_sections_follow_the_mode_of_the_whole_notebook(spark, rows):
    df = cells(
        spark,
        # the manifest names no code cell, so tags decide; rules are not asked
        ("b", ["# mlops: manifest\n# cell 1: training\n# cell 9: metrics", ("markdown", "text"), "# mlops: config\nmodel.fit(X)", "f1_score(a, b)"]),
        ("m", ["# mlops: config\nx", "# mlops: manifest\n# cell 0: imports\n# cell 0-2: training", ("markdown", "# mlops: metrics")]),
        ("i", [" \n", "import os", "# mlops: nope\ny_hat = 1"]))
    got = rows(nb.section_cells(df), "notebook", "mode", "index", "section", "confidence")
    assert got == [("b", "blueprint", 2, "config", 1.0), ("i", "inferred", 1, "imports", 0.95), ("i", "inferred", 2, "evaluation", 0.85),
                   ("m", "manifest", 0, "imports", 1.0), ("m", "manifest", 0, "training", 1.0), ("m", "manifest", 1, "training", 1.0)]
    assert rows(nb.notebook_modes(df)) == [("b", "blueprint"), ("i", "inferred"), ("m", "manifest")]
    assert rows(nb.code_usage(df), "notebook", "metrics") == [("b", ["f1"]), ("i", []), ("m", [])]


def test_matches_agree_with_the_plain_expression(spark):
    from modelwarden.functions.patterns import needed_texts
    from modelwarden.plans.notebook_queries import TEXT_RULES

    every = [p for _, _, ps in [*nb.SECTION_RULES, *TEXT_RULES] for p in ps] + [*nb.METRIC_PATTERNS.values(), *nb.MODEL_PATTERNS.values()]
    texts = ["a@b.de", "@", "Licence", "LICENSE", "copyright", "https://x", "ftp://x", "12345", "555-123-4567", "model.compile(a, optimizer)",
             "xgb.train(", "XGBClassifier", "lgbRegressor", "y_hat = 1", "X_test=", "feature_x", "encode_", "params = {", "r2_score", "auc", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in every:
        got = df.select(nb.matches(F.col("t"), p).alias("a"), F.regexp_like("t", F.lit(p)).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got], p
    assert needed_texts(r"(ab|c)+x?d{2,}") == ["ab", "c"] or needed_texts(r"(ab|c)+x?d{2,}") == ["d"]
    assert needed_texts(r"(?i)abc") == [] and needed_texts(r"a|\d") == [] and needed_texts(r"https?://") == ["http"]
    assert needed_texts(r"[a-z]+@\w+") == ["@"] and needed_texts(r"(foo|bar)baz?") == ["foo", "bar"]
