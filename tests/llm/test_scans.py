"""Periodic runs, licence notices and spelling variants against plain versions, and the defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwarden.llm import licence_scan, periodic_runs, spelling
from modelwarden.llm.common import table
from modelwarden.llm.queries import QUERIES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} the of{i % 13}" for i in range(20_000))
ODD = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", "en", "a", 3), (4, "short", None, "a", 5),
       (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)),
       (None, "a text that has no id at all", "fr", "b", 1), (7, "12345 !!! 678", "de", "a", 13),
       (8, "x" * 30_000, "de", "c", 30_000)]
CLASHING = ["runs", "collapsed", "n_words", "places", "spans", "score", "row", "word", "near", "bin", "form", "root", "_"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]


# Periodic runs

def plain_runs(words, least=periodic_runs.LEAST):
    """Every lag on its own: stretches of equal words, the smallest lag of a stretch first."""
    n, found = len(words), {}
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.array([numbers[w] for w in words])
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], at[:-q] == at[q:], [False]]).astype(np.int8)
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if e - s + q >= max(least, 2 * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, gone = plain_runs(words), set()
    for s, size, q in runs:
        gone.update(range(s + q, s + size))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{size},{q}\n" for s, size, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], *sha)


def test_runs_query_equals_plain(spark):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = QUERIES["op11_periodic_runs"](spark, MEDIUM)
    assert got.columns == names
    assert {tuple(r) for r in got.collect()} == {plain_digest(d, t) for d, t in documents(spark, MEDIUM)}


def periodic_texts(rng):
    """Texts over few words: random, periodic with faults, nested periods, one word, Fibonacci."""
    n, kind = rng.randint(0, 150), rng.randint(0, 4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        words = ([rng.choice("abc") for _ in range(rng.randint(1, 40))] * 150)[:n]
        for _ in range(rng.randint(0, 3) if n else 0):
            words[rng.randrange(n)] = "z"
        return words
    if kind == 2:
        return ((["a"] * rng.randint(6, 30) + ["b"]) * rng.randint(1, 4) + ["a"] * rng.randint(0, 20)) * 3
    if kind == 3:
        return ["a"] * n
    a, b = "a", "ab"
    for _ in range(rng.randint(4, 9)):
        a, b = b, b + a
    return list(b * rng.randint(1, 2))


@pytest.mark.parametrize("least", [12, 7, 4])
def test_runs_of_repetitive_texts(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [periodic_texts(rng) for _ in range(rng.randint(1, 5))]
        _, words, owner, sizes = periodic_runs.numbered([" ".join(t).encode() for t in texts])
        first = np.cumsum(sizes + 1) - sizes - 1
        got = [[] for _ in texts]
        for s, size, q in periodic_runs.find(words, owner, least):
            got[owner[s]].append((s - first[owner[s]], size, q))
        assert got == [plain_runs(t, least) for t in texts]


def test_runs_of_long_periodic_texts():
    """One word 200,000 times, and blocks of one word within a longer period: seeds stay few."""
    for words, count in ((["a"] * 200_000, 1), ((["a"] * 100 + ["b"]) * 1000, 1001)):
        _, numbers, owner, _ = periodic_runs.numbered([" ".join(words).encode()])
        found = periodic_runs.find(numbers, owner)
        assert len(found) == count and found[0][0] == 0
        assert max(found, key=lambda r: r[1])[1] == len(words)


def test_runs_odd_rows(spark, odd, empty):
    got = periodic_runs.periodic_runs(odd, odd.columns)
    assert sorted(got.columns) == sorted(odd.columns)
    rows = {r.doc_id: r for r in got.collect()}
    assert all(rows[i].runs == [] and rows[i].collapsed == "" and rows[i].n_words == 0 for i in (1, 2, 3))
    assert rows[5].runs == rows[6].runs == [] and rows[5].score == 7 and len(rows[5].collapsed) == len(LONG)
    assert got.count() == len(ODD) and periodic_runs.periodic_runs(empty, ["doc_id"]).count() == 0


# Licence notices

def test_matching_statistics_equal_plain():
    rng = random.Random(5)
    for _ in range(300):
        seqs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        automaton = licence_scan.Automaton(seqs)
        got = {p: (state, size) for p, state, size in automaton.statistics(text)}
        for j in range(len(text)):
            sizes = [m for m in range(1, j + 2) if any(
                q[i : i + m] == text[j + 1 - m : j + 1] for q in seqs for i in range(len(q) - m + 1))]
            want = max(sizes, default=0)
            state, size = got.get(j, (0, 0))
            assert size == want
            if want:
                here = text[j + 1 - want : j + 1]
                assert sorted(automaton.ends[state]) == sorted(
                    (n, i + want) for n, q in enumerate(seqs) for i in range(len(q) - want + 1) if q[i : i + want] == here)


def test_licence_base_columns_equal_plain(spark):
    want = set()
    for doc_id, text in documents(spark, MEDIUM):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                           "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(i, label) for phrase, label in licence_scan.PHRASES.items() for i in range(len(words))
                  if words[i : i + len(phrase.split())] == phrase.split()]
        want.add((doc_id, len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
                  ",".join(sorted({x for _, x in places}))))
    got = QUERIES["op12_licence_scan"](spark, MEDIUM)
    assert {tuple(r)[:6] for r in got.collect()} == want
    assert got.where("n_base > 0 and score < 1 or score < 0 or score > 1").count() == 0
    notices = got.join(table(spark, MEDIUM, "documents"), "doc_id").where("text like '%Released under the MIT License%'")
    assert notices.count() and notices.where("not array_contains(split(labels, ','), 'mit')").count() == 0


def scanned(text, **options):
    scanner = licence_scan.Scanner(options.get("templates", licence_scan.TEMPLATES), licence_scan.PHRASES)
    return scanner.scan([w for w in licence_scan.words_of(text.encode()) if w])


def test_notice_with_changes_is_one_span():
    label, notice = licence_scan.TEMPLATES[12]
    changed = notice.replace("free of charge", "without charge").replace("publish, distribute", "publish (and) distribute")
    _, spans, score = scanned(f"Copyright someone. {changed} The end. {notice}")
    mine = [s for s in spans if s["template"] == 12]
    assert [s["label"] for s in mine] == [label] * 2 and score == 1 and mine[0]["share"] == 1 and 0.9 < mine[1]["share"] < 1
    # The four words before the first change are no long match, so the span begins behind them.
    assert mine[1]["first"] == 7 and mine[1]["last"] < mine[0]["first"]


def test_scattered_words_are_no_span():
    _, notice = licence_scan.TEMPLATES[12]
    words = notice.split()
    far = " ".join(" ".join(words[i : i + 6]) + " lorem" * 20 for i in range(0, len(words), 6))
    places, spans, score = scanned(far)
    assert not places and not spans and score < 0.2


def test_matches_cross_slices(monkeypatch):
    text = "x y z " + licence_scan.TEMPLATES[1][1] + " all rights reserved cc by"
    want = scanned(text)
    monkeypatch.setattr(licence_scan, "SLICE", 3)
    assert scanned(text) == want


def test_licence_odd_rows(spark, odd, empty):
    got = licence_scan.scan_licences(odd, odd.columns)
    rows = {r.doc_id: r for r in got.collect()}
    assert all(rows[i].places == [] and rows[i].spans == [] and rows[i].score == 0 and rows[i].n_words == 0 for i in (1, 2, 3))
    assert rows[5].n_words == 60_000 and rows[7].n_words == 2 and rows[5].runs == 7 and got.count() == len(ODD)
    assert licence_scan.scan_licences(empty, ["doc_id"]).count() == 0


# Spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_by_gaps(words):
    """Near words by brute force over patterns with one place left out: equal patterns at the same place, or a pattern that is a word."""
    blanks, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            blanks.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in blanks.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    return near


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near, form = near_by_gaps(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return rows


def test_variants_query_equals_plain(spark):
    got = QUERIES["op13_spelling_variants"](spark, MEDIUM)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    assert {tuple(r) for r in rows} == plain_variants(documents(spark, MEDIUM)) and len(rows) == len({r.word for r in rows})


def test_neighbours_equal_brute_force():
    rng = random.Random(3)
    for _ in range(120):
        letters = rng.choice(["ab", "abc", "abàéz"])
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 80))})
        asked = [w for w in [*words, "qqqq", "abab"] for _ in (0, 1)]
        left, right = spelling.neighbours(words, asked, [False, True] * (len(asked) // 2))
        got = sorted((asked[i], words[j]) for i, j in zip(left, right))
        assert got == sorted((a, b) for a in asked[::2] for b in words if one_edit(a, b))


@pytest.mark.parametrize("bin_size", [200_000, 60])
def test_near_words_in_blocks(spark, bin_size):
    """Words that share a part, in bins far smaller than the part's words: no pair is lost or doubled."""
    rng = random.Random(9)
    words = sorted({"aaaa" + "".join(rng.choice("ab") for _ in range(rng.randint(3, 6))) for _ in range(80)})
    df = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n bigint")
    got = sorted((r.word, r.near) for r in spelling.near_words(df, bin_size).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_roots_follow_long_chains(spark):
    pairs = [(f"w{i}", f"w{i + 1}") for i in range(11)]
    got = spelling.roots(spark.createDataFrame(pairs, "word string, form string")).collect()
    assert {tuple(r) for r in got} == {(w, "w11") for w, _ in pairs}


def test_spelling_odd_rows(spark, odd, empty):
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
    got = {r.word: r.n for r in spelling.vocabulary(odd, shortest=4).collect()}
    assert got == {"word": 60_000}
    text = "Erwachsene Erwachsene erwachsne erwachsne " + "erwachsene " * 30 + "ÉCOLIERS ÉCOLIERS"
    rows = spark.createDataFrame([(1, text, "a")], "doc_id bigint, text string, near string")
    got = {r.word: r for r in spelling.variants(spelling.vocabulary(rows)).collect()}
    assert got["erwachsne"].form == got["erwachsne"].root == "erwachsene" and got["erwachsene"].form is None
    assert got["Écoliers"].n == 2 and got["Écoliers"].n_near == 0
