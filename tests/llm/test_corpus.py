"""Corpus operators against plain versions, and the defined results for odd rows."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from modelwarden.llm import (
    ann, components, decontamination, language_id, lm_scoring, mixing, sharding, simhash, substring_dedup, toxicity,
    training_order,
)
from modelwarden.llm.common import fold, table
from modelwarden.llm.queries import QUERIES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} the of{i % 13}" for i in range(20_000))
ODD = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", "en", "a", 3), (4, "short", None, "a", 5),
       (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)),
       (None, "a text that has no id at all", "fr", "b", 1), (7, "12345 !!! 678", "de", "a", 13),
       (8, "x" * 30_000, "de", "c", 30_000)]
CLASHING = ["score", "shard", "slot", "fp", "node", "topic", "probability", "taken", "row", "bytes", "seed", "words", "root",
            "_copy_of", "lang_pred", "leaf", "n"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]


# Language identification

def test_language_held_out_accuracy(spark):
    rows = QUERIES["op5_language_id"](spark, MEDIUM).join(table(spark, MEDIUM, "documents"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_language_counts_match_plain_counting(spark):
    rows = [("en", "Ab ab."), ("fr", "élan"), ("en", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {(r.lang, r.bucket): r.n for r in language_id.training_counts(df).collect()}
    want = Counter()
    for lang, text in rows:
        chars = [ord(c.lower()) if c.isalpha() else 32 for c in text or ""] + [32] * 2
        for i in range(len(chars) - 2):
            for g in language_id.gram_buckets(np.array(chars[i : i + 3], np.uint32)):
                want[lang, int(g[0])] += 1
    blank = set(language_id.blank_buckets())
    assert got == {k: v for k, v in want.items() if k[1] not in blank}


def test_language_prediction_matches_plain_naive_bayes(spark):
    """Every posterior, with any number of languages in a block; more languages than a block are no error."""
    rng = np.random.default_rng(4)
    rows = [(i, f"l{i % 11:02d}" if i % 9 else None, "".join(rng.choice(list("abcdé .X"), size=int(rng.integers(0, 40)),
                                                             p=np.roll([.3, .2, .1, .1, .1, .1, .05, .05], i % 4))))
            for i in range(120)] + [(500, "l00", None), (501, "l03", "... 12")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    blank = set(language_id.blank_buckets())

    def grams(text):
        chars = [ord(c.lower()) if c.isalpha() else 32 for c in text or ""] + [32] * 2
        got = (int(g[0]) for i in range(len(chars) - 2) for g in language_id.gram_buckets(np.array(chars[i : i + 3], np.uint32)))
        return [g for g in got if g not in blank]

    counts = {}
    for _, lang, text in rows:
        if lang:
            counts.setdefault(lang, Counter()).update(grams(text))
    want = {}
    for i, _, text in rows:
        logs = [sum(np.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * language_id.BUCKETS)) for g in grams(text)) for _, c in sorted(counts.items())]
        best = int(np.argmax(np.round(logs, 9)))
        letters = any(c.isalpha() for c in text or "")
        want[i] = (sorted(counts)[best], 1 / sum(np.exp(x - logs[best]) for x in logs)) if letters else ("und", 0.0)
    for block in (2, 5, 128):
        model = language_id.fit(df, block=block)
        assert len(model) == -(-11 // block)
        got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model, ["doc_id"]).collect()}
        assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
        assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
        plain = {(r.lang, r.bucket): r.n for r in language_id.training_counts(df, block).collect()}
        assert plain == {(k, g): n for k, c in counts.items() for g, n in c.items()}


def test_language_takes_columns_of_any_name(spark):
    names = ["row", "text", "best", "total", "others", "c0", "none", "lang"]
    df = spark.createDataFrame([("r", "hello there", "b", "t", "o", "c", "n", "en")], ", ".join(f"{c} string" for c in names))
    got = language_id.identify(df, df, names).first().asDict()
    assert [got[c] for c in names] == ["r", "hello there", "b", "t", "o", "c", "n", "en"] and got["lang_pred"] == "en" and got["score"] == 1


def test_language_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in language_id.identify(odd, odd, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and got[1].score == 0
    assert got[5].lang_pred == "en" and got[5].score == got[6].score
    assert language_id.identify(odd, empty, ["doc_id"]).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language_id.identify(empty, odd, ["doc_id"]).count() == 0


# SimHash

def plain_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, ids, linked):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if linked(fps[i], fps[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(x for x in (least.get(root(i)), d) if x is not None) if d is not None or root(i) in least else None
    return [least[root(i)] for i in range(len(fps))]


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_fingerprints_and_components(spark, block):
    docs = documents(spark, SMALL)
    fps = [plain_fingerprint(t) for _, t in docs]
    want = plain_components(fps, [d for d, _ in docs], lambda a, b: (a ^ b).bit_count() <= 3)
    got = simhash.near_duplicates(table(spark, SMALL, "documents"), ["doc_id"], block=block).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, want)}


def test_hash_is_that_of_spark(spark):
    one = spark.createDataFrame([("Ab cD ef",)], "text string")
    h = one.select(F.xxhash64(F.lower("text"))).first()[0] & (2**64 - 1)
    assert simhash.shingle_hashes(b"Ab cD  ef", 3).tolist() == [h] == [simhash.majority(np.array([h], np.uint64))]


def test_tree_finds_every_pair(monkeypatch):
    monkeypatch.setattr(simhash, "leaf_size", lambda n: 40)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 63, 600, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 600, dtype=np.uint64))
    points = np.concatenate([base, near])
    nodes = simhash.build_tree(points[::2], len(points), 3)
    assert len(nodes) > 5
    index, leaf = simhash.deal(points, nodes, 3)
    leaves = [set(leaf[index == i].tolist()) for i in range(len(points))]
    assert all(leaves[i] & leaves[i + 600] for i in range(600))


def test_similarity_links(spark):
    words = [f"w{i}" for i in range(400)]
    near = words[:200] + ["other"] + words[201:]  # 5 of 396 shingles differ
    far = words[:150] + [f"z{i}" for i in range(250)]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (2, " ".join(far)), (9, " ".join(words).upper())]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[1], rows[2]])


def test_similarity_links_of_texts_with_a_word_repeated_often(spark):
    words = [f"w{i}" for i in range(500)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["menu"] * 50))]  # 496 of 501 shingles are shared
    plain = [plain_fingerprint(t, 5) for _, t in rows]
    assert (plain[0] ^ plain[1]).bit_count() > 22
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()] == [1]


@pytest.mark.parametrize("group", [simhash.GROUP, 4])
def test_similarity_links_are_exact_at_the_threshold(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rows, want = [], set()
    for n in range(120):  # sets of shingles of which the second is a part: 640 or 639 of 800
        words, part = [f"p{n}x{i}" for i in range(804)], 644 - n % 2
        rows += [(1000 + n, " ".join(words)), (2000 + n, " ".join(words[:part]))]
        want |= {1000 + n} | ({2000 + n} if n % 2 else set())
    chain = [f"c{i}" for i in range(1000)]  # neighbours share 276 of 316 shingles, the next but one 256 of 336
    rows += [(1 + i, " ".join(chain[20 * i : 20 * i + 300])) for i in range(30)]
    rows += [(40, "a b c d e f g h"), (41, "a b c d e f g h i"), (42, "a b c d e f g"), (42, "a b c d e f g")]  # 4 of 5, 3 of 4
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(kept) == sorted(want | {1, 40, 42})


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((60, 0.8), (2000, 0.8), (2000, 0.4)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        b = a.copy()
        cut = int(n * 2 * share / (1 + share))
        b[cut:] = rng.integers(0, 2**63, n - cut, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        x, y = (np.frombuffer(simhash.sketch(v)[1], np.uint64)[None, :] for v in (a, b))
        assert abs(simhash.similar(x, y)[0] - share) < 0.12


@pytest.mark.parametrize("bits", [simhash.MARKS, 64])
def test_texts_that_are_not_wanted_stay_out_of_the_join(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "MARKS", bits)
    rows = spark.range(500).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("h"))
    wanted = rows.where("doc_id % 100 = 0 OR doc_id IS NULL").select(F.col("doc_id").alias("a"), F.col("h").alias("b"))
    kept = simhash.marked(rows, ["doc_id", "h"], wanted, ["a", "b"])
    assert kept.columns == ["doc_id", "h"]
    ids = [r.doc_id for r in kept.collect()]
    assert {None, 100, 200, 300, 400} <= set(ids) and len(ids) == len(set(ids)) < (8 if bits > 64 else 150)


def test_near_duplicate_stage_shuffles_whole_rows_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 1), (2, "g h i j k l", 2), (3, None, 3)]
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, n int"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the rows, and the keys of those that stay
        assert sorted((r.doc_id or 0, r.n) for r in kept.collect()) == [(0, 1), (2, 2), (3, 3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_simhash_odd_rows(spark, odd, empty):
    got = {(r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicates(odd, ["doc_id"]).collect()}
    assert {(i, 1, "0" * 16) for i in (1, 2, 3)} <= got
    assert {c for d, c, _ in got if d in (5, 6)} == {5}
    assert simhash.near_duplicates(empty, ["doc_id"]).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert sorted(kept, key=str) == sorted([None, 1, 4, 5, 7, 8], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = dict((r.node, r.root) for r in components.components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# Decontamination (the check SQL covers the whole tables)

def test_leak_with_substitutions(spark, odd, empty):
    item = [f"q{i}" for i in range(30)]
    held = item.copy()
    held[7], held[19] = "other", "other"
    rows = [(1, "a b " + " ".join(held) + " c"), (2, " ".join(item[:9])), (3, None), (4, ", ".join(item).upper()), (4, " ".join(item))]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short"), (13, "")], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.matched, r.start) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(1, 10, 19, 2), (4, 10, 20, 0)} or got == {(1, 10, 19, 10), (4, 10, 20, 0)}
    assert decontamination.leaks(odd, bench).count() == 0 == decontamination.leaks(empty, bench).count()
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_masks_leave_no_gap():
    for length in range(1, decontamination.WINDOW + 1):
        extra = decontamination.whole_masks(length)
        assert not extra or length < 8
        for p in decontamination.substitutions(length):
            whole = any(all(c == "0" or at + k not in p for k, c in enumerate(m)) for m, at in extra)
            assert whole or any(decontamination.hit(m, length, p) for m in decontamination.MASKS), (length, p)


def brute_leaks(docs, items, window=20, share=0.8):
    out = set()
    for d, words in docs:
        for i, item in items:
            best, win = {}, min(window, len(item))
            for shift in range(-len(item), len(words) + 1):
                same = [0 <= j + shift < len(words) and words[j + shift] == w for j, w in enumerate(item)]
                for s in range(len(item) - win + 1):
                    best.setdefault((sum(same[s : s + win]), -s - shift), 0)
            if item and max(best)[0] >= math.ceil(win * share):
                out.add((d, i, max(best)[0], win, -max(best)[1]))
    return out


def test_leaks_of_items_of_all_lengths_match_brute_force(spark):
    """Items of 1 to 26 words with as many words substituted as may be and one more, some cut off by an end of the text."""
    rng = random.Random(11)
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in range(1, 27)] + [(40, ["a", "b"] * 12), (41, ["a"] * 9)]
    docs = []
    for _ in range(400):
        n, item = rng.choice(items)
        m = min(20, n) - math.ceil(min(20, n) * 0.8) if n < 40 else 2
        gone = rng.sample(range(len(item)), min(len(item), rng.choice([0, m, m, m + 1])))
        held = [f"x{rng.randrange(9)}" if k in gone else w for k, w in enumerate(item)]
        held = held[rng.choice([0, 0, 1]) : len(held) - rng.choice([0, 0, 1])]
        docs.append((len(docs), rng.choices("pqab", k=rng.randrange(4)) + held + rng.choices("pqab", k=rng.randrange(4))))
    want = brute_leaks(docs, items)
    assert {i for _, i, *_ in want} == {i for i, _ in items}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = decontamination.leaks(frame, bench)
    assert {(r.doc_id, r.item_id, r.matched, r.window, r.start) for r in got.collect()} == want
    longer = {r.item_id for r in decontamination.leaks(frame, bench, shortest=7).collect()}
    assert longer == {i for i, w in items if len(w) >= 7}


# Sharding

def test_shards_are_exact_and_gapless(spark, odd, empty):
    rows = QUERIES["op3_sharding"](spark, MEDIUM).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = dict(documents(spark, MEDIUM))
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
               for r in rows)
    got = sharding.shuffle_to_shards(odd, 3, block_rows=2)
    assert got.count() == len(ODD) and {"shard", "slot"} <= set(got.columns)
    assert sorted((r.shard, r.slot) for r in got.collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert sharding.shuffle_to_shards(empty, 4).count() == 0


def test_sharding_query_deals_whole_documents(spark, monkeypatch):
    dealt, real = [], sharding.shuffle_to_shards

    def watched(df, *args, **kwargs):
        out = real(df, *args, **kwargs)
        dealt.append((df.columns, out.columns))
        return out

    monkeypatch.setattr(sharding, "shuffle_to_shards", watched)
    assert QUERIES["op3_sharding"](spark, SMALL).count() == table(spark, SMALL, "documents").count()
    columns = table(spark, SMALL, "documents").columns
    assert dealt == [(columns, [*columns, "shard", "slot"])]


def test_matrix_margins_and_distribution():
    parts, sizes = [5, 0, 20, 7], sharding.shard_sizes(32, 3)
    draws = np.stack([sharding.communication_matrix(parts, sizes, seed) for seed in range(3000)])
    assert (draws.sum(axis=2) == parts).all() and (draws.sum(axis=1) == sizes).all()
    assert np.abs(draws.mean(axis=0) - np.outer(parts, sizes) / 32).max() < 0.12
    assert abs(draws[:, 2, 0].var() - 20 * (11 / 32) * (21 / 32) * (12 / 31)) < 0.25


def test_mixing_is_one_to_one():
    x = sharding.mix(np.arange(100_000, dtype=np.uint64), 5)
    assert len(np.unique(x)) == 100_000


# Mixing (the check SQL covers the whole tables)

def test_raking_meets_targets(spark, odd, empty):
    docs = table(spark, MEDIUM, "documents").select("doc_id", "source", "lang", mixing.topic().alias("topic"), mixing.tokens().alias("n_tokens"))
    targets = {"source": 0.85, "lang": {"en": 0.4, "fr": 0.3}, "topic": 0.85}
    rows = mixing.calibrate(docs, targets, sweeps=30).collect()
    weight = Counter()
    for r in rows:
        weight[r.lang] += r.probability * r.n_tokens
    total = sum(weight.values())
    assert abs(weight["en"] / total - 0.4) < 1e-6 and abs(weight["fr"] / total - 0.3) < 1e-6
    assert max(r.probability for r in rows) == pytest.approx(1)
    strange = odd.withColumns({"topic": mixing.topic(), "n_tokens": mixing.tokens()})
    assert mixing.calibrate(strange, {"source": 1.0, "topic": 1.0}).where("probability > 0").count() == len(ODD)
    none = empty.withColumns({"topic": mixing.topic(), "n_tokens": mixing.tokens()})
    assert mixing.calibrate(none, {"lang": 0.5}).count() == 0


def test_one_rare_document_does_not_empty_the_mixture(spark, empty):
    rows = [(i, "some words of prose", ("en", "fr", "de")[i % 3], ("web", "book")[i % 5 > 0], 19) for i in range(6000)]
    docs = spark.createDataFrame([*rows, (9999, "one more", "xx", "rare", 8)], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SMALL).collect()}
    assert 9999 in kept and len(kept) > 0.47 * len(rows)
    facts = docs.withColumns({"topic": mixing.topic(), "n_tokens": mixing.tokens()})
    mixed = mixing.calibrate(facts, {"source": 0.85, "lang": 0.85}, keep=0.6, tolerance=1e-3)
    share = mixed.agg(F.sum(F.col("probability") * F.col("n_tokens")) / F.sum("n_tokens"), F.max("probability")).first()
    assert share[0] == pytest.approx(0.6) and share[1] == 1
    assert corpus_pipeline.mix_sources(spark, empty, SMALL).count() == 0


# Nearest neighbours

def brute_nearest(rows, k):
    ids = sorted(rows)
    m = np.array([rows[i] for i in ids], float)
    out = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            s = (m * m[n]).sum(axis=1)
            out[i] = [(ids[j], s[j]) for j in np.lexsort((ids, -s)) if j != n][:k]
    return out


def test_nearest_recall_and_scores(spark):
    rows = {r.vec_id: r.embedding for r in table(spark, MEDIUM, "embeddings").collect()}
    want = brute_nearest(rows, 20)
    got = {}
    for r in QUERIES["op6_nearest_neighbours"](spark, MEDIUM).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want) and all([x[0] for x in v] == list(range(1, 21)) for v in got.values())
    found = sum(len({x[1] for x in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * 20 * len(want)
    m = {i: np.array(v, float) for i, v in rows.items()}
    assert all(abs(s - (m[q] * m[i]).sum()) < 1e-12 for q, v in got.items() for _, i, s in v)


def test_nearest_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, None), (120, [0.0, 0.0]), (140, [1.0, None]), (160, [float("nan"), 1.0]),
            (180, [float("inf"), 1.0]), (200, [1.0]), (220, []), (None, [1.0, 1.0]), (41, [1.0, 0.0]), (70, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("key", F.lit(1))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40}
    assert got[0] == [(70, 3.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)] and got[40] == [(70, 3.0), (0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]
    few = df.where("vec_id in (20, 21, 70)")
    assert ann.nearest(few, few.where("vec_id = 20"), k=5).count() == 2
    assert ann.nearest(df.limit(0), df, k=5).count() == 0


def test_answers_are_never_short(spark, monkeypatch):
    """Many tiny tight clusters and one visit: visits widen until k rows have been seen."""
    monkeypatch.setattr(ann, "calibrated_visits", lambda *args: 1)
    rng = np.random.default_rng(5)
    ends = rng.normal(size=(150, 6))
    points = [(i, (ends[i % 150] * 9 + rng.normal(size=6) * 0.01).tolist()) for i in range(900)]
    df = spark.createDataFrame(points, "vec_id bigint, embedding array<double>")
    visited = ann.Tree(np.array([p for _, p in points]), 900)
    assert visited.leaves() > 5
    got = Counter(r.query_id for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=200).collect())
    assert got == {i: 200 for i in range(0, 900, 20)}
    few = ann.nearest(df, df.where("vec_id % 20 = 0"), k=1000).groupBy("query_id").count()
    assert {r["count"] for r in few.collect()} == {899}


# Repeated strings

def brute_removed(texts, length=400):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_removed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeated_spans(df).collect())
    want = brute_removed([(t or "").encode() for _, t in rows])
    assert got == sorted((d, *w) for (d, _), w in zip(rows, want))


def test_repeated_strings_of_the_tables(spark):
    check_removed(spark, documents(spark, SMALL))


def test_repeated_strings_planted(spark):
    rng = np.random.default_rng(3)

    def noise(n):
        return "".join(rng.choice(list("abcdefgh é"), n))

    shared, edge, short = noise(700), noise(400), noise(399)
    rows = [(0, noise(300) + shared + noise(500)), (1, noise(20) + shared), (2, shared[100:600] + noise(90)), (3, edge), (4, noise(7) + edge),
            (5, short), (6, "z" + short), (7, "ab" * 900), (8, "x" * 2000), (9, "x" * 399), (10, None), (11, ""),
            (12, noise(800)), (13, noise(5) + shared[:399] + noise(9)), (14, (noise(37) * 60))]
    check_removed(spark, rows)


def test_parse_in_pieces_meets(monkeypatch):
    text = "".join(np.random.default_rng(4).choice(list("abcdef "), 9000)).encode()
    whole = substring_dedup.parse(text)
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    pieces = substring_dedup.parse(text)
    assert all((whole[k] == pieces[k]).all() for k in whole)


def test_repeated_strings_empty(spark, empty, odd):
    assert substring_dedup.repeated_spans(empty).count() == 0
    got = Counter((r.doc_id, r.n_bytes - r.n_removed) for r in substring_dedup.repeated_spans(odd).collect())
    assert got[5, 0] == 1 and got[6, 0] == 2 and got[8, 0] == 1 and got[1, 0] == 1


# Training order

@pytest.mark.parametrize("total", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(total):
    slots = training_order.feistel(np.arange(total), total, key=9)
    assert sorted(slots.tolist()) == list(range(total))
    if total == 1000:
        assert abs(np.corrcoef(slots, np.arange(total))[0, 1]) < 0.15
        assert (slots != training_order.feistel(np.arange(total), total, key=10)).any()


def test_training_files_round_trip(spark, odd, empty):
    for df, length, per_shard in ((table(spark, SMALL, "documents").repartition(3), 256, 50), (odd, 64, 7)):
        folder = training_order.new_folder(spark)
        index = training_order.write_training_order(df, folder, length, per_shard).orderBy("slot").collect()
        assert [r.slot for r in index] == list(range(len(index))) and all(r.slot == r.shard * per_shard + r.row for r in index)
        read = list(training_order.read_slots(folder, 0, len(index), length, per_shard))
        assert [zlib.crc32(x.tobytes()) for x in read] == [r.ids_crc32 for r in index]
        assert [x.tolist() for x in training_order.read_slots(folder, 5, 4, length, per_shard)] == [x.tolist() for x in read[5:9]]
        order = sorted(range(len(index)), key=lambda s: index[s].sequence)
        stream = np.concatenate([read[s][: index[s].n_tokens] for s in order])
        ends = np.flatnonzero(stream == training_order.END)
        bpe = training_order.encoding(training_order.VOCABULARY)
        texts = [bpe.decode(x.tolist()[(k > 0):]) for k, x in enumerate(np.split(stream, ends)[:-1])]
        assert sorted(texts) == sorted(r.text or "" for r in df.select("text").collect())
        named = {d for r in index for d in r.doc_ids}
        assert named == {r.doc_id for r in df.select("doc_id").collect()}
    assert training_order.write_training_order(empty, training_order.new_folder(spark)).count() == 0


def test_long_runs_alone_are_cut():
    bpe = training_order.encoding(training_order.VOCABULARY)
    prose = "Ordinary words, 12 of them, keep the ids that they have anywhere else. " * 90
    run = "".join(chr(97 + i * i % 26) for i in range(10_000))
    ids = training_order.encode(f"{prose}{run} {prose}").tolist()
    n = training_order.LONG_RUN
    want = bpe.encode_ordinary(prose + run[:n]) + bpe.encode_ordinary(run[n : 2 * n]) + bpe.encode_ordinary(f"{run[2 * n :]} {prose}")
    assert ids == want and bpe.decode(ids) == f"{prose}{run} {prose}"
    assert ids[: len(bpe.encode_ordinary(prose)) - 1] == bpe.encode_ordinary(prose)[:-1]
    for odd in (" " * 20_000 + "x", "é" * 9000, prose, "", None):
        assert bpe.decode(training_order.encode(odd).tolist()) == (odd or "")
    assert training_order.encode(prose).tolist() == bpe.encode_ordinary(prose)


def test_shard_folder_is_qualified(spark):
    assert training_order.new_folder(spark).startswith("file:///")


# Toxicity

def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else MEDIUM
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    rows = toxicity.score(docs.join(labels, "doc_id").where((fold("doc_id", 5) == 0) & (F.col("quality") == 1)), model,
                          ["doc_id", "toxic"]).collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.05 * len(clean)
    # Letters inserted into a known insult leave a higher score than clean text has.
    odd = spark.createDataFrame([(1, "you are an idiot today"), (2, "you are an id.i.ot today"), (3, "you are an idxiot today"),
                                 (4, "you are an i d i o t today"), (5, "you are an other today")], "doc_id bigint, text string")
    score = {r.doc_id: r.score for r in toxicity.score(odd, model, ["doc_id"]).collect()}
    assert min(score[i] for i in (1, 2, 3, 4)) > score[5] and score[1] == pytest.approx(score[2]) == pytest.approx(score[4])


def test_subsequence_kernel_matches_plain_sum():
    word, other = "stupid", "st-u-pid".replace("-", "x")

    def subsequences(w):
        out = Counter()
        for i in range(len(w)):
            for g in range(toxicity.GAPS + 1):
                for h in range(toxicity.GAPS + 1):
                    if i + 2 + g + h < len(w):
                        out[w[i] + w[i + 1 + g] + w[i + 2 + g + h]] += toxicity.DECAY ** (g + h)
        return out

    a, b = (next(iter(toxicity.word_strings([w])[0])) for w in (word, other))
    x, y = subsequences(word), subsequences(other)
    norm = toxicity.norms()[len(word)] * toxicity.norms()[len(other)]
    assert toxicity.kernel([a], [b])[0, 0] == pytest.approx(sum(x[k] * y[k] for k in x) / norm)


def test_norm_of_a_very_long_word():
    size = 400_000
    row, table = np.ones(size, np.uint8), np.ones(toxicity.SYMBOLS**3)
    plain = [(w, size - 2 - g - h) for g, h, w in toxicity.WEIGHTS]
    want = sum(w * n for w, n in plain) / sum(w * w * n for w, n in plain) ** 0.5
    assert toxicity.subsequence_sums(row, np.array([0]), table)[0] == pytest.approx(want)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (6, None), (None, 1), (99, 0), (4, 3)], "doc_id bigint, toxic int")
    rows = toxicity.score(odd, toxicity.fit(odd, labels), ["doc_id"]).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(odd, labels.limit(0))
    assert toxicity.score(odd, none, ["doc_id"]).where("predicted <> 0").count() == 0
    assert toxicity.score(empty, none, ["doc_id"]).count() == 0


# Language-model scoring

def test_base_scores(spark):
    rows = QUERIES["op1_lm_scoring"](spark, SMALL).collect()
    texts = {d: (t or "").encode().lower().split() + [b"\0end"] for d, t in documents(spark, SMALL)}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, t in texts.items() if not held[d] for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert np.isfinite(r.score) and r.score < 0
    assert len(rows) == len(texts)


def test_model_probabilities_add_up():
    rng = np.random.default_rng(5)
    counts = rng.poisson(3, lm_scoring.IDS)
    units, inside = lm_scoring.units_of(counts)
    pairs = rng.poisson(0.01, (lm_scoring.UNITS, lm_scoring.UNITS)).astype(float)
    kind, logs, after = lm_scoring.neighbour_logs(pairs)
    model = lm_scoring.Attention(logs)
    model.p["out"] += rng.standard_normal(model.p["out"].shape).astype(np.float32)
    texts = [rng.integers(0, 3000, 100).astype("<u2")]
    own, before, _, _, counted, first = lm_scoring.windows_of(texts, units)
    assert counted.sum() == 100
    z, x = model.hidden(own, before, first)["z"][0, 10], own[0, lm_scoring.OVERLAP + 10]
    ids = np.arange(lm_scoring.IDS)
    u = units[ids]
    n = len(ids)
    total = model.logs(np.repeat(z[None], n, axis=0), np.full(n, x), kind[u]) + after[x, u] + inside[ids]
    assert np.exp(total).sum() == pytest.approx(1, abs=1e-3)


def test_attention_is_causal_and_learns():
    rng = np.random.default_rng(6)
    logs = np.log(np.full((lm_scoring.UNITS, lm_scoring.CLASSES), 1 / lm_scoring.CLASSES, np.float32))
    model = lm_scoring.Attention(logs)
    own = rng.integers(0, 50, (32, lm_scoring.WINDOW))
    before, begins = np.roll(own, 1, axis=1), np.arange(32) % 2 == 0
    first = model.hidden(own, before, begins)["z"].copy()
    later, place = own.copy(), lm_scoring.OVERLAP + 12
    later[:, place:] = 51
    assert np.allclose(model.hidden(later, before, begins)["z"][:, :12], first[:, :12], atol=1e-6)
    earlier = own.copy()
    earlier[:, : lm_scoring.OVERLAP] = 51  # seen as context, but not where the text begins
    moved = np.abs(model.hidden(earlier, before, begins)["z"] - first).max(axis=(1, 2)) > 1e-6
    assert (moved == ~begins).all()
    last = own[:, lm_scoring.OVERLAP :]
    target, counted = last % lm_scoring.CLASSES, np.ones(last.shape, bool)

    def loss():
        return -model.logs(model.hidden(own, before, begins)["z"][counted], last[counted], target[counted]).mean()

    start = loss()
    for _ in range(60):
        model.learn(own, before, target, counted, begins)
    assert loss() < 0.5 * start


def test_slopes_of_the_loss():
    """Along its gradient every parameter changes the loss by the gradient's length, however the batch is parted."""
    rng = np.random.default_rng(9)
    logs = rng.standard_normal((lm_scoring.UNITS, lm_scoring.CLASSES)).astype(np.float32)
    logs -= np.log(np.exp(logs).sum(axis=1, keepdims=True))
    model = lm_scoring.Attention(logs)
    for name in ("out", "distance", "own", "before"):
        model.p[name] += 0.3 * rng.standard_normal(model.p[name].shape).astype(np.float32)
    texts = [rng.integers(0, 40, n).astype("<u2") for n in (1, 30, 700, 500)]
    own, before, target, _, counts, first = lm_scoring.windows_of(texts, np.arange(lm_scoring.IDS) % 50)
    assert len(own) > lm_scoring.PART and len(own) % lm_scoring.PART and not counts.all()
    target = target % lm_scoring.CLASSES

    def loss():
        z = model.hidden(own, before, first)["z"]
        return -model.logs(z[counts], own[:, lm_scoring.OVERLAP :][counts], target[counts]).mean()

    model.find_slopes(own, before, target, counts, first)
    for name, slope in model.slopes.items():
        length = np.linalg.norm(slope)
        step, kept = 1e-2 * slope / length, model.p[name].copy()
        model.p[name][...] = kept + step
        above = loss()
        model.p[name][...] = kept - step
        assert (above - loss()) / 2e-2 == pytest.approx(length, rel=0.05), name
        model.p[name][...] = kept


def test_each_distinct_word_is_encoded_once(monkeypatch):
    """Ids are those of the whole texts, though the vocabulary reads a shard's distinct words only."""
    def whole(text):
        return [*training_order.encode(" " + text.decode("utf-8", "replace") if text else ""), training_order.END]

    odd = ["it's don't 'll '", "z" * 5000 + " ok", "\x1c q \u00a0", "a\u00a0 \u00a0b", "\u3000 abc123!? \u65e5\u672c", "x" * 4096, ""]
    texts = [b" ".join(t.encode().split()) for t in odd] + [b"", b"\xff\xfe a\xc3 b", b"plain words", b"plain"]
    for some in (texts, texts[::-1], [], [b""]):
        names, codes, n_words, ids, n_ids = lm_scoring.words_and_ids(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n_ids))[:-1]] == list(map(whole, some))
        assert n_words.tolist() == [len(t.split()) for t in some]
        flat = [w for t in some for w in t.split()]
        assert len(names) == len(set(flat)) and len(set(zip(flat, names[codes].tolist()))) == len(names)
    read, bpe = [], training_order.encoding(training_order.VOCABULARY)

    class Counting:
        def encode_to_numpy(self, text, **_):
            read.append(text)
            return bpe.encode_to_numpy(text, disallowed_special=())

        def __getattr__(self, name):
            return getattr(bpe, name)

    lm_scoring.id_bytes(training_order.VOCABULARY)
    monkeypatch.setattr(lm_scoring, "encoding", lambda path: Counting())
    monkeypatch.setattr(training_order, "encoding", lambda path: Counting())
    lm_scoring.words_and_ids([b"one two three two"] * 50)
    assert read == [" one two three"]


def test_only_chosen_windows_are_made():
    texts = [np.arange(n, dtype="<u2") for n in (1, 24, 25, 300)]
    units, chosen = np.arange(lm_scoring.IDS), np.array([0, 3, 5, 11])
    every, some = lm_scoring.windows_of(texts, units), lm_scoring.windows_of(texts, units, lambda n: chosen)
    assert all(np.array_equal(a[chosen], b) for a, b in zip(every, some))


def test_every_training_window_is_learned_from_once():
    dealt = [lm_scoring.windows_of_round(1001, 3 << 24, 256, number) for number in range(lm_scoring.ROUNDS)]
    assert sorted(np.concatenate(dealt).tolist()) == list(range(1001)) and min(map(len, dealt)) > 400


def test_lm_odd_rows(spark, odd, empty):
    marked = odd.withColumn("held_out", F.coalesce(F.col("doc_id") == 4, F.lit(False)))
    rows = lm_scoring.score_texts(marked).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r.score) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].score == by[2][0].score == by[3][0].score and by[1][0].n_tokens == 1
    assert len({r.score for r in by[5] + by[6]}) == 1
    untaught = lm_scoring.score_texts(odd.withColumn("held_out", F.lit(True))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in untaught)
    assert lm_scoring.score_texts(empty.withColumn("held_out", F.lit(False))).count() == 0


# Pipeline

def test_leaks_are_told_apart_by_text(spark):
    """A clean row that shares its doc_id, or has none either, stays; whatever the table's other columns are called."""
    item = table(spark, SMALL, "benchmark").where("length(text) > 60").first().text
    names = ["row", "key", "text_key", "hit_id", "_leak_id", "first_id", "first_hash", "text_hash", "_text_hash", "copy", "_copy",
             "_set_hash", *sharding.WORKING]
    rows = [(None, f"before {item} after"), (None, "clean one"), (7, f"{item}"), (7, "clean two"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    got = corpus_pipeline.drop_leaks(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.select("doc_id", "text").collect())) == sorted(
        map(repr, docs.where("text IS NULL OR text LIKE 'clean%'").select("doc_id", "text").collect()))
    twice = docs.union(docs)
    for kept in (got, corpus_pipeline.drop_near_duplicates(spark, twice, SMALL), sharding.shuffle_to_shards(docs, 2)):
        assert all(r[n] == i for r in kept.collect() for i, n in enumerate(names))
    assert corpus_pipeline.drop_near_duplicates(spark, twice, SMALL).count() == 4  # the two leaking texts are alike


def test_pipeline_stages(spark, odd, empty):
    docs = table(spark, MEDIUM, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, MEDIUM).cache()
        seen[name] = (before, {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()})
        assert docs.columns == columns and seen[name][1] <= before
    before, after = seen["SimHash near-dedup"]

    def shingles(text):
        w = text.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(t) for d, t in before}
    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    pairs = {(a, b) for v in index.values() if len(v) < 60 for a in v for b in v if a < b}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    stayed = {d for d, _ in after}
    close = [p for p, s in alike.items() if s >= 0.8]
    assert not any(a in stayed and b in stayed for a, b in close)
    partners = {d for p, s in alike.items() if s >= 0.8 for d in p}
    assert {d for d, _ in before} - stayed <= partners
    before, after = seen["benchmark decontamination"]
    leaked = {r.doc_id for r in decontamination.leaks(spark.createDataFrame(list(before), "doc_id bigint, text string"),
                                                      table(spark, MEDIUM, "benchmark")).collect()}
    assert leaked and {d for d, _ in before} - {d for d, _ in after} == leaked
    assert corpus_pipeline.STAGES[-1][1](spark, docs, MEDIUM).count() > 0
    for strange in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            result = stage(spark, strange, SMALL)
            assert result.count() <= max(strange.count(), 4000)
