"""Words one edit apart, by search schemes on bidirectional FM-indexes, and the common form of rare variants.

A word of L code points is parted after L // 2. A word one edit (insert, delete, replace) away agrees with it on all of the first
part or on all of the second one, so two searches find every such word: match the first part from the left delimiter on and
extend across the second one with one error, or match the second part from the right delimiter on and extend leftwards. Both
keep the suffix ranks in the forward and in the reverse index in step; a pattern with both delimiters is one word, and its
forward rank is the word's place in the sorted vocabulary.

The vocabulary is dealt by parts: a word is indexed under every first and every second part that a word one edit away can have, and
asks under its own two. Parts share bins of about BIN code points, each of which gets an index of its own. A part with more
words than a bin is cut into blocks of index and asking words, a bin for each pair of blocks. No pair is lost, and nothing
but the vocabulary is ever shuffled.

Words are told apart as they are. Null texts have no words; empty tables give empty tables; repeated rows count as often as they
occur. The tables that come in may have any other columns, they are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwarden.session import materialise

#: Code points of a bin, about; places between two checkpoints of an index; states extended at once.
BIN, STEP, STATES = 200_000, 64, 1 << 15
#: Least code points of a word, least occurrences, and how much commoner a form is than its variant.
SHORTEST, OFTEN, RATIO = 7, 2, 10
LETTERS = r"A-Za-zÀ-ÿ"


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN, word: Column | None = None) -> DataFrame:
    """(word, n) of maximal runs of letters, A-Z in lower case, of at least `shortest` code points and `often` occurrences.

    `word` may rewrite a run; it sees the columns of docs as `row` and the lower-cased run as `word`.
    """
    runs = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{shortest},}})"))
    words = docs.select(F.struct(*docs.columns).alias("row"), F.explode(runs).alias("word"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.when(F.col("word").rlike("[A-Z]"), F.translate("word", upper, upper.lower())).otherwise(F.col("word"))
    words = words.withColumn("word", lowered).select((F.col("word") if word is None else word).alias("word"))
    counts = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= often)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words one after the other, code points of each)."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.array([len(w) for w in words], np.int64)


class Index:
    """Rank structure of the Burrows-Wheeler transform of a cyclic text of symbols below `symbols`."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while True:
            key = rank * (n + symbols) + np.roll(rank, -width)
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.diff(key[order]) != 0]).cumsum()
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                break
            width *= 2
        bwt = text[order - 1]
        blocks = n // STEP + 1
        self.bwt = np.full(blocks * STEP, symbols, text.dtype)
        self.bwt[:n] = bwt
        self.bwt = self.bwt.reshape(blocks, STEP)
        spot = np.arange(n) // STEP * symbols + bwt
        counts = np.bincount(spot, minlength=blocks * symbols).reshape(blocks, symbols)
        self.before = np.vstack([np.zeros((1, symbols), np.int64), np.cumsum(counts, axis=0)[:-1]]).astype(np.int32)
        self.smaller = np.hstack([np.zeros((blocks, 1), np.int32), np.cumsum(self.before, axis=1, dtype=np.int32)])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]])
        self.symbols = symbols

    def ranks(self, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        block, off = at // STEP, at % STEP
        here = np.where(np.arange(STEP) < off[:, None], self.bwt[block], self.symbols)
        spot = np.arange(len(at))[:, None] * (self.symbols + 1) + here
        found = np.bincount(spot.ravel(), minlength=len(at) * (self.symbols + 1)).reshape(len(at), -1)
        return self.before[block] + found[:, :-1]

    def extend(self, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (here, in the other index, size) of the patterns grown by each symbol on this index's side."""
        start = self.ranks(low)
        sizes = self.ranks(low + size) - start
        return self.first + start, other[:, None] + np.cumsum(sizes, axis=1) - sizes, sizes


    def one(self, low: np.ndarray, other: np.ndarray, size: np.ndarray, symbol: np.ndarray):
        """The intervals of `extend` for one symbol of each pattern, a known one."""
        block, off = low // STEP, low % STEP
        until, rest = (low + size) // STEP, (low + size) % STEP
        wanted = symbol.astype(self.bwt.dtype)[:, None]
        here, there = self.bwt[block], self.bwt[until]
        inside, beyond = np.arange(STEP, dtype=np.int8) < off[:, None], np.arange(STEP, dtype=np.int8) < rest[:, None]
        start = self.before[block, symbol] + np.count_nonzero((here == wanted) & inside, axis=1)
        end = self.before[until, symbol] + np.count_nonzero((there == wanted) & beyond, axis=1)
        less = (self.smaller[until, symbol] + np.count_nonzero((there < wanted) & beyond, axis=1)
                - self.smaller[block, symbol] - np.count_nonzero((here < wanted) & inside, axis=1))
        return self.first[symbol] + start, other + less, end - start


class Vocabulary:
    """Bidirectional FM-index of sorted distinct words, a delimiter (symbol 0) before each."""

    def __init__(self, words: list[str]):
        points, sizes = spelled(words)
        self.alphabet, self.count = np.unique(points), len(words)
        text = np.zeros(len(points) + len(words), np.min_scalar_type(len(self.alphabet) + 1))
        text[np.arange(len(points)) + np.repeat(np.arange(len(words)), sizes) + 1] = np.searchsorted(self.alphabet, points) + 1
        self.forward = Index(text, len(self.alphabet) + 1)
        self.reverse = Index(text[::-1].copy(), len(self.alphabet) + 1)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; those that no indexed word has are one past the last symbol."""
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points
        return np.where(known, at + 1, len(self.alphabet) + 1)

    def one_error(self, asked: list[str], leftwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """(asking word, indexed word) pairs one edit apart that agree on the first part, or leftwards on the second one.

        An insertion never repeats the symbol it stands before, a deletion never has an equal symbol behind it, so every
        pair comes up once.
        """
        index = self.forward if leftwards else self.reverse
        points, size = spelled([w[::-1] for w in asked] if leftwards else asked)
        exact = size - size // 2 if leftwards else size // 2
        start = np.cumsum(size + 1) - size - 1
        symbol = np.zeros(len(points) + len(asked), np.int64)  # a delimiter ends every word
        symbol[np.arange(len(points)) + np.repeat(np.arange(len(asked)), size)] = self.symbols(points)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(np.arange(len(asked)), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64),
                 np.zeros(len(asked), np.int64), np.full(len(asked), self.count), np.zeros(len(asked), bool))]
        while todo:
            states = todo.pop()
            if len(states[0]) > STATES:
                todo += [tuple(x[:STATES] for x in states), tuple(x[STATES:] for x in states)]
                continue
            who, at, low, other, count, erred = states
            here = symbol[start[who] + at]
            known = here < index.symbols
            lows, others, grown = index.one(low, other, count, np.where(known, here, 0))
            grown = np.where(known, grown, 0)
            done = (at == size[who]) & erred & (grown > 0)
            if done.any():
                found.append((who[done], (lows if leftwards else others)[done]))
            onward = (at < size[who]) & (grown > 0)
            new = [tuple(x[onward] for x in (who, at + 1, lows, others, grown, erred))]
            free = ~erred & (at >= exact[who])
            if free.any():
                w, p = who[free], at[free]
                lows, others, sizes = index.extend(low[free], other[free], count[free])
                r, c = np.nonzero(sizes)
                keep = (c != 0) & (c != here[free][r])
                r, c = r[keep], c[keep]
                branch = (lows[r, c], others[r, c], sizes[r, c], np.ones(len(r), bool))
                new.append((w[r], p[r], *branch))
                inner = p[r] < size[w[r]]
                new.append(tuple(x[inner] for x in (w[r], p[r] + 1, *branch)))
            gone = free & (at < size[who])
            gone[gone] = here[gone] != symbol[start[who[gone]] + at[gone] + 1]
            new.append(tuple(x[gone] for x in (who, at + 1, low, other, count, np.ones(len(who), bool))))
            states = tuple(np.concatenate(x) for x in zip(*new))
            if len(states[0]):
                todo.append(states)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


def neighbours(indexed: list[str], asked: list[str], second: list[bool]) -> tuple[list[int], list[int]]:
    """(place in asked, place in indexed) of words one edit apart that agree on the first part, or only on the second one."""
    index = Vocabulary(indexed)
    left, right = [], []
    for leftwards in (False, True):
        mine = [i for i, s in enumerate(second) if s == leftwards]
        if not mine:
            continue
        who, word = index.one_error([asked[i] for i in mine], leftwards)
        for i, j in zip(who.tolist(), word.tolist()):
            half = asked[mine[i]]
            if not leftwards or not indexed[j].startswith(half[: len(half) // 2]):
                left.append(mine[i])
                right.append(j)
    return left, right


def dealt(words: DataFrame, bin_size: int) -> DataFrame:
    """(bin, word, n, asks, second) of indexed words, and of those that ask with one of their parts."""
    size = F.length("word")

    def parts(cuts: list[tuple[Column, Column]]) -> Column:
        firsts = [F.struct(F.lit(False).alias("second"), F.col("word").substr(F.lit(1), c).alias("part")) for c, _ in cuts]
        seconds = [F.struct(F.lit(True).alias("second"), F.col("word").substr(size - c + 1, c).alias("part")) for _, c in cuts]
        return F.explode(F.array_distinct(F.array(*firsts, *seconds)))

    def halves(n: Column) -> tuple[Column, Column]:
        first = F.floor(n / 2).cast("int")
        return first, (n - first).cast("int")

    asking = words.select("word", "n", parts([halves(size)]).alias("key"), F.lit(True).alias("asks"))
    index = words.select("word", "n", parts([halves(size - 1), halves(size), halves(size + 1)]).alias("key"),
                         F.lit(False).alias("asks"))
    rows = asking.unionByName(index).select("word", "n", "asks", "key.second", "key.part")
    weight = rows.where("not asks").groupBy("second", "part").agg(F.sum(size + 1).alias("weight"))
    weight = materialise(weight, "word-parts")
    total = weight.agg(F.sum("weight")).first()[0] or 0
    bins = int(total // bin_size) + 1
    # Blocks of a part: most have one. The table of the others has at most total / bin_size rows.
    large = weight.where(F.col("weight") > bin_size).select("second", "part", F.ceil(F.col("weight") / bin_size).alias("blocks"))
    rows = rows.join(large, ["second", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks"))
    rows = rows.withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("asks"), F.struct(F.col("met").alias("i"), F.col("own").alias("j"))).otherwise(
        F.struct(F.col("own").alias("i"), F.col("met").alias("j")))
    place = F.when(F.col("blocks") == 1, F.concat(F.lit("b"), F.pmod(F.xxhash64("second", "part"), F.lit(bins)))).otherwise(
        F.concat_ws(" ", F.lit("c"), F.col("second").cast("string"), "part", cell["i"], cell["j"]))
    return rows.select(place.alias("bin"), "word", "n", "asks", "second")


def near_words(words: DataFrame, bin_size: int = BIN) -> DataFrame:
    """(word, near, near_n) of every pair of words (columns word and n, distinct words) exactly one edit apart, both ways round."""

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        held = table.filter(pa.array(~asks))
        sizes = dict(zip(held.column("word").to_pylist(), held.column("n").to_pylist()))
        ask = table.filter(pa.array(asks))
        names, indexed = ask.column("word").to_pylist(), sorted(sizes)
        left, right = neighbours(indexed, names, ask.column("second").to_pylist()) if names and indexed else ([], [])
        return pa.table({"word": pa.array([names[i] for i in left], pa.string()),
                         "near": pa.array([indexed[j] for j in right], pa.string()),
                         "near_n": pa.array([sizes[indexed[j]] for j in right], pa.int64())})

    found = dealt(words, bin_size).groupBy("bin").applyInArrow(search, "word string, near string, near_n bigint")
    return found.distinct()  # words can meet in a bin under two parts


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form (columns word and form): the last of its forms, by doubling steps.

    A form is several times as common as its variant, so there are no circles and few steps.
    """
    state = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                           F.col("next").isNotNull().alias("moved"))
        moved = materialise(moved, "roots")
        state = moved.drop("moved")
        if not moved.where("moved").head(1):
            return state


def variants(words: DataFrame, ratio: int = RATIO, bin_size: int = BIN) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its commonest near word, if `ratio` times as common, and the last form."""
    words = materialise(words.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, bin_size).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    common = -F.col("best.less") >= ratio * F.col("n")
    found = materialise(found.select(
        "word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(common, -F.col("best.less")).alias("form_n")), "variants")
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
