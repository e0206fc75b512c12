"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts the three-letter subsequences they share. Letters may lie apart by up to GAPS others, and
every letter between them costs a factor DECAY, so an insult with letters inserted keeps most of its subsequences; what is
neither letter nor digit is dropped inside words, and single letters in a row ("l o s e r") are read as one word. The kernel
is divided by the norm that a word of that length has if no subsequence recurs.

Labels belong to texts, and few words of a toxic text are insults, so learning is multiple-instance: each toxic text
starts with the word whose letter n-grams tell toxic from clean texts best, an SVM (squared hinge, in the space of the
Nystroem features of the landmarks) is trained against words of clean texts, witnesses are chosen anew by its
decisions, and clean words that come out highest join the negatives. The score of a text is a logistic function of its
highest word. As the kernel is a sum over subsequences, the machine folds into one table of subsequence weights; every
word of every text is scored with that table in numpy.

The training sample is bounded by SAMPLE texts a class, chosen by a hash of doc_id; scoring reads whole texts.

Defined results: null, empty and wordless texts get the score of a text with no evidence; rows with null or other labels
teach nothing; with only one class learned every score is 0 (or 1, if only toxic rows were given); repeated rows are
scored each; other columns are passed by unread.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwarden.llm.common import byte_sizes, chunks

#: Labelled texts that training takes of each class, at most.
SAMPLE = 2000
LANDMARKS = 192
GAPS, DECAY = 2, 0.6
SYMBOLS = 64
SLICE = 1 << 20
BREAK, DROPPED = 0, 255
WEIGHTS = [(g, h, DECAY ** (g + h)) for g in range(GAPS + 1) for h in range(GAPS + 1)]


@cache
def symbols() -> np.ndarray:
    """Symbol of every code point: letters in lower case and digits, a word break for white space, or dropped."""
    out = np.full(sys.maxunicode + 1, DROPPED, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isspace():
            out[i] = BREAK
        elif c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low - 96 if 97 <= low <= 122 else 37 + low % 27
        elif "0" <= c <= "9":
            out[i] = 27 + i - 48
    return out


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all words in a row, start of each word, text of each word)."""
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    table = symbols()
    codes = np.concatenate([x for p in points for x in (table[p], [BREAK])]).astype(np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) + 1 for p in points])
    used = codes != DROPPED
    codes, owner = codes[used], owner[used]
    letter = codes != BREAK
    before = np.concatenate([[False], letter[:-1]])
    starts = np.flatnonzero(letter & ~before)
    # The number of letters up to each start places words in the row of letters alone.
    place = np.concatenate([[0], np.cumsum(letter)])[starts]
    own, row = owner[starts], codes[letter]
    size = np.diff(np.append(place, len(row)))
    single = size == 1
    joined = np.concatenate([[False], single[1:] & single[:-1] & (own[1:] == own[:-1])]) if len(own) else single
    return row, place[~joined], own[~joined]


def norm_of(size: np.ndarray) -> np.ndarray:
    """Norm, for every length, of the subsequence weights of a word in which none recurs; 1 where there is none."""
    total = sum(w * w * np.maximum(0, size - 2 - g - h) for g, h, w in WEIGHTS)
    return np.sqrt(np.where(total > 0, total, 1.0))


@cache
def norms(limit: int = 4096) -> np.ndarray:
    """The norms of the lengths below `limit`."""
    return norm_of(np.arange(limit))


def subsequence_sums(row: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For every word the weighted sum of `table` over its subsequences, divided by the norm of its length."""
    if not len(starts):
        return np.zeros(0)
    size = np.diff(np.append(starts, len(row)))
    word = np.repeat(np.arange(len(starts), dtype=np.int32), size)
    at = row.astype(np.int32)
    total = np.zeros(len(row) + 1, np.float64)
    for g, h, weight in WEIGHTS:
        j, k = 1 + g, 2 + g + h
        n = len(row) - k
        if n > 0:
            key = (at[:n] * SYMBOLS + at[j : j + n]) * SYMBOLS + at[k : k + n]
            total[:n] += np.where(word[:n] == word[k : k + n], weight * table[key], 0.0)
    by = norms()
    norm = by[np.minimum(size, len(by) - 1)]
    long = size >= len(by)
    norm[long] = norm_of(size[long])
    return np.add.reduceat(total[:-1], starts) / norm


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters in a row and starts of non-empty strings of symbols (as made by `word_strings`)."""
    size = np.array([len(x) for x in strings], np.int64)
    row = np.frombuffer("".join(strings).encode("latin-1"), np.uint8)
    return row, np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)


def word_strings(texts: list[str | None]) -> list[set[str]]:
    """The distinct words of each text, one character per symbol, of three symbols or more."""
    out: list[set[str]] = [set() for _ in texts]
    known: dict[str, str] = {}
    row, starts, own = words(texts)
    flat, ends = row.tobytes().decode("latin-1"), np.append(starts[1:], len(row))
    for s, e, o in zip(starts.tolist(), ends.tolist(), own.tolist()):
        if e - s >= 3:
            word = flat[s:e]
            out[o].add(known.setdefault(word, word))
    return out


def weight_table(word: str) -> np.ndarray:
    """The word's own subsequence weights, divided by its norm, as a table."""
    table = np.zeros(SYMBOLS**3)
    row = np.frombuffer(word.encode("latin-1"), np.uint8).astype(np.int64)
    for g, h, weight in WEIGHTS:
        n = len(row) - 2 - g - h
        if n > 0:
            np.add.at(table, (row[:n] * SYMBOLS + row[1 + g : 1 + g + n]) * SYMBOLS + row[2 + g + h :][:n], weight)
    return table / norm_of(np.array(len(row)))


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Kernel of all words with some, a table at a time."""
    row, starts = encode(left)
    return np.stack([subsequence_sums(row, starts, weight_table(w)) for w in right], axis=1)


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one the bias) of a squared-hinge SVM, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, last = np.zeros(x.shape[1]), None
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        inside = y * (x @ w) < 1
        if last is not None and (inside == last).all():
            break
        last = inside
        a = x[inside] * c[inside, None]
        w = np.linalg.solve(np.diag(penalty) + a.T @ x[inside], a.T @ y[inside])
    return w


def first_witnesses(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """For every toxic text the word with the n-gram (of four or five letters) that tells toxic from clean texts best."""
    def grams(word: str) -> set[str]:
        return {word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1)}

    seen, other = Counter(), Counter()
    for side, count in ((toxic, seen), (clean, other)):
        for text in side:
            count.update({g for w in text for g in grams(w)})
    n, m = len(toxic), max(1, len(clean))

    def tells(g: str) -> float:
        p, q = seen[g] / n, (other[g] + 0.5) / m
        return (p - q) / (p / n + q / m + 1e-9) ** 0.5

    strength = {g: tells(g) for g, times in seen.items() if times > 2}
    del seen, other
    out = []
    for text in toxic:
        best = max(((max((strength.get(g, 0.0) for g in grams(w)), default=0.0), w) for w in text), default=(0.0, ""))
        if best[0] > 3:
            out.append(best[1])
    return out


def spread_landmarks(candidates: list[str], limit: int) -> list[str]:
    """Up to `limit` words, each the one that the landmarks so far explain least."""
    chosen: list[str] = []
    if not candidates:
        return chosen
    near = np.zeros(len(candidates))
    row, starts = encode(candidates)
    for _ in range(min(limit, len(candidates))):
        at = int(np.argmin(near))
        if chosen and near[at] > 0.95:
            break
        chosen.append(candidates[at])
        near = np.maximum(near, subsequence_sums(row, starts, weight_table(candidates[at])))
        near[at] = 2.0
    return chosen


def train(texts: list[str | None], toxic: np.ndarray) -> dict:
    """Subsequence weight table, bias, and slope and offset of the logistic function, from labelled texts."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return {"table": np.zeros(SYMBOLS**3), "bias": 0.0, "slope": 0.0, "offset": 50.0 if toxic.any() else -50.0}
    bags = word_strings(texts)
    bad, good = [b for b, t in zip(bags, toxic) if t], [b for b, t in zip(bags, toxic) if not t]
    clean_words = sorted(set().union(*good))
    rng = np.random.default_rng(5)
    positives = first_witnesses(bad, good)
    innocent = set(clean_words)
    common = [w for w, _ in Counter(w for w in positives if w not in innocent).most_common(3000)]
    picked = [clean_words[i] for i in sorted(rng.permutation(len(clean_words))[:8000])]
    negatives, table, bias = set(picked), np.zeros(SYMBOLS**3), 0.0
    row, starts = encode(clean_words)
    bag_words = sorted(set().union(*bad) - innocent)
    bag_row, bag_starts = encode(bag_words)
    for _ in range(4):
        if not common:
            break
        marks = spread_landmarks(common, LANDMARKS * 3 // 4) + picked[: LANDMARKS // 4]
        gram = kernel(marks, marks)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        rest = sorted(negatives)
        x = kernel(common + rest, marks) @ root
        y = np.concatenate([np.ones(len(common)), -np.ones(len(rest))])
        w = svm(x, y, np.where(y > 0, 10.0 * max(1.0, len(rest) / len(common) / 10), 10.0))
        table, bias = sum(a * weight_table(m) for a, m in zip(root @ w[:-1], marks)), float(w[-1])
        high = subsequence_sums(row, starts, table) + bias
        negatives.update(clean_words[i] for i in np.argsort(-high)[:2000])
        judged = dict(zip(bag_words, subsequence_sums(bag_row, bag_starts, table) + bias))
        best = Counter()
        for text in bad:
            top = max(((judged[v], v) for v in text if v in judged), default=(-9.0, ""))
            if top[0] > 0:
                best[top[1]] += 1
        common = [v for v, _ in best.most_common(3000)]
    flat, first, own = words(texts)
    level = text_levels(flat, first, own, len(texts), table, bias)
    slope, offset = logistic(level, toxic)
    return {"table": table, "bias": bias, "slope": slope, "offset": offset}


def text_levels(row: np.ndarray, starts: np.ndarray, own: np.ndarray, texts: int, table: np.ndarray, bias: float) -> np.ndarray:
    """Decision of the highest word of every text; that of a word without subsequences where there are no words."""
    out = np.full(texts, bias)
    if len(starts):
        values = subsequence_sums(row, starts, table) + bias
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[first]] = np.maximum.reduceat(values, first)
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and offset of P(y) by penalised Newton steps."""
    a = np.stack([x, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """(text, toxic) of up to `per_class` labelled texts of each class, those with the least hash of doc_id."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").distinct()
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(per_class).union(
        known.where("toxic = 0").orderBy(*order).limit(per_class))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model learned from labels (doc_id, toxic) of docs (doc_id, text); the sample is bounded by SAMPLE a class."""
    rows = training_sample(docs, labels).orderBy("text", "toxic").toArrow()
    return train(rows.column("text").to_pylist(), rows.column("toxic").to_numpy() == 1)


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row with score (0 to 1) and predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("_scored_text")
            levels = [np.zeros(0)]
            for lo, hi in chunks(byte_sizes(texts), SLICE):
                levels.append(text_levels(*words(texts[lo:hi].to_pylist()), hi - lo, m["table"], m["bias"]))
            p = 1 / (1 + np.exp(-np.clip(m["slope"] * np.concatenate(levels) + m["offset"], -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=[*kept.names, "score", "predicted"])

    return docs.select(*keep, F.col("text").alias("_scored_text")).mapInArrow(run, schema)
