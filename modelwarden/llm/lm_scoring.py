"""Scoring of whole texts by a causal self-attention model on subword ids, trained here in numpy.

Texts are read once into shards: A-Z in lower case, words apart by one space, subword ids of a public byte-level BPE, and
an end id. A shard's distinct words are encoded once each. Three things are learned from the training texts, all of them in passes over all shards:

* word counts for the base score, exact over all training words: each shard lists its distinct words by hash with their
  counts, a shuffle by word adds them up, and each shard gets back the totals of its own words only;
* counts of subword ids and of neighbouring units. The SINGLE most frequent ids are units of their own, the others share
  units by frequency, where an id has its share of the counts plus one. Units with like neighbours form classes;
* a causal self-attention layer. A position sees its unit and the one before, attends to the positions before it with a
  learned bias by distance, and corrects the log-probabilities that counts of neighbours give to the class of the next
  unit; the unit within the class follows from the counts. Shards train copies by Adam on a fixed share of their
  windows; after each round the copies are averaged, weighted by windows.

Scoring lays windows of WINDOW places over each text, each starting OVERLAP before the last one ended, runs them in batches
under one causal mask, and counts each id once: in the window that holds it among its last FRESH places.

Defined results: null and empty texts have only the end; equal texts score alike; repeated rows are scored each; with no
training text, words have no counts and the model is uniform over ids; very long texts run over many windows; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwarden.llm.common import chunks
from modelwarden.llm.substring_dedup import Hashes
from modelwarden.llm.training_order import END, LONG_RUN, VOCABULARY, encode, encoding
from modelwarden.session import materialise

IDS = END + 1
SINGLE, GROUPS, CLASSES = 2000, 48, 64
UNITS = SINGLE + GROUPS
WIDTH, WINDOW, OVERLAP = 32, 32, 8
FRESH = WINDOW - OVERLAP
#: The training windows are dealt to the rounds, so each is learned from once.
ROUNDS, BATCH, STEP = 2, 128, 1e-2
#: Windows and rows that scoring handles at a time: small enough for the processor's caches.
TOGETHER, ROWS = 32, 768
#: Windows whose gradients are found at a time, and parameters that Adam moves at a time.
PART, STRETCH = 32, 1 << 14
SHARD_BYTES = 12 << 20
SPACE = 32
#: In UTF-8, white space that words may hold.
OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


@cache
def id_bytes(path: str) -> np.ndarray:
    """Bytes of every id."""
    out = np.zeros(IDS, np.int64)
    for token in encoding(path).token_byte_values():
        out[encoding(path).encode_single_token(token)] = len(token)
    return out


def valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def words_and_ids(texts: list[bytes], path: str = VOCABULARY) -> tuple[np.ndarray, ...]:
    """(hash of every distinct word, number of every word in that list, words of every text, ids, ids of every text).

    The words of a text are apart by one space. A piece of the vocabulary's pattern never goes on behind a space, so
    every distinct word is encoded once; texts where that does not hold, for other white space or cuts, are encoded whole.
    """
    data = b"".join(b" " + t for t in texts if t)
    places = np.flatnonzero(np.frombuffer(data, np.uint8) == SPACE)
    edges = pa.py_buffer(np.append(places, len(data)).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(places), [None, edges, pa.py_buffer(data)]).dictionary_encode()
    del data, places, edges
    codes = words.indices.to_numpy()
    n_words = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    ends = np.frombuffer(words.dictionary.buffers()[1], np.int64)[: len(words.dictionary) + 1]
    listed, sizes = words.dictionary.buffers()[2], np.diff(ends)
    listed, ends = (listed.to_pybytes() if len(sizes) else b"")[: ends[-1] if len(sizes) else 0], ends[1:]
    names = np.zeros(len(sizes), np.uint64)
    for i, j in chunks(sizes, 1 << 16):  # tables of powers are as long as what is hashed at a time
        base = ends[i] - sizes[i]
        names[i:j] = Hashes(np.frombuffer(listed[base : ends[j - 1]], np.uint8)).of(ends[i:j] - sizes[i:j] + 1 - base, ends[i:j] - base)

    plain = sizes <= LONG_RUN
    plain[np.searchsorted(ends, [m.start() for m in OTHER_SPACE.finditer(listed)], side="right")] = False
    if not valid(listed):
        plain &= [valid(listed[e - n : e]) for e, n in zip(ends, sizes)]
    del words
    spans = np.where(plain, sizes, 0)
    read = np.frombuffer(listed, np.uint8)[np.repeat(plain, sizes)].tobytes()
    found = encoding(path).encode_to_numpy(read.decode(), disallowed_special=())
    behind = np.searchsorted(np.cumsum(id_bytes(path)[found]), np.cumsum(spans), side="right")
    n_codes, found, end = np.diff(behind, prepend=0), found.astype("<u2"), np.array([END], "<u2")

    n_ids, ids, past = np.zeros(len(texts), np.int64), [], np.cumsum(n_words)
    for i, text in enumerate(texts):
        own = codes[past[i] - n_words[i] : past[i]]
        if plain[own].all():
            n = n_codes[own]
            ends = np.cumsum(n)
            places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(behind[own] - ends, n)
            ids.append(found[places])
        else:
            ids.append(encode(" " + text.decode("utf-8", "replace"), path).astype("<u2"))
        n_ids[i] = len(ids[-1]) + 1
        ids.append(end)
    return names, codes, n_words, np.concatenate([end[:0], *ids]), n_ids


def shards(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per shard: documents, ids, and words as numbers of a list of distinct word hashes with training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 24, 0
        doc_ids, held_out, texts, held = [], [], [], 0

        def cut() -> pa.RecordBatch:
            nonlocal doc_ids, held_out, texts, held, number
            names, codes, words, ids, n_ids = words_and_ids(texts, path)
            training = np.repeat(~np.array(held_out, bool), words)
            counts = np.bincount(codes[training], minlength=len(names)).astype(np.int32)
            row = {"shard": part + number, "doc_ids": doc_ids, "held_out": held_out, "n_words": words.tolist(),
                   "n_ids": n_ids.tolist(), "ids": pack(ids), "codes": pack(codes.astype("<u4")),
                   "names": names.astype("<u8").tobytes(), "counts": counts.tobytes()}
            number += 1
            doc_ids, held_out, texts, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        kinds = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                           ("n_words", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("ids", pa.binary()),
                           ("codes", pa.binary()), ("names", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(),
                                         batch.column("_bytes")):
                joined = b" ".join((text.as_py() or b"").lower().split())
                texts.append(joined)
                doc_ids.append(doc_id)
                held_out.append(bool(out))
                held += len(joined) + 64
                if held >= SHARD_BYTES:
                    yield cut()
        if doc_ids:
            yield cut()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", F.col("text").cast("binary").alias("_bytes"))
    return rows.mapInArrow(run, "shard bigint, doc_ids array<bigint>, held_out array<boolean>, n_words array<bigint>, "
                                "n_ids array<bigint>, ids binary, codes binary, names binary, counts binary")


def word_list(rows: DataFrame) -> DataFrame:
    """(shard, at, word, n): the distinct words of each shard with their training counts there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, names, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "names", "counts"))):
                names, counts = np.frombuffer(names, "<i8"), np.frombuffer(counts, np.int32)
                for s in range(0, len(names), 1 << 18):
                    part = names[s : s + (1 << 18)]
                    yield pa.record_batch({"shard": np.full(len(part), shard, np.int64),
                                           "at": np.arange(s, s + len(part), dtype=np.int32), "word": part,
                                           "n": counts[s : s + (1 << 18)]})

    return rows.select("shard", "names", "counts").mapInArrow(run, "shard bigint, at int, word bigint, n int")


BASE = "shard bigint, doc int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double"


def base_scores(rows: DataFrame) -> tuple[DataFrame, int]:
    """(shard, doc, ..., base_score) of every document, and the number of training tokens."""
    own = Window.partitionBy("word")
    # A word has a row per shard that holds it, so no word is hot here.
    listed = materialise(word_list(rows).select("shard", "at", "n", F.sum("n").over(own).alias("c"),
                                                F.row_number().over(own.orderBy("shard")).alias("k")), "words")
    facts = listed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"),
                       F.count(F.when((F.col("k") == 1) & (F.col("c") > 0), 1)).alias("distinct")).first()
    training = rows.select(F.size(F.filter("held_out", lambda x: ~x)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, kinds = int(facts["words"] + training), int(facts["distinct"] + (training > 0))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        counts = np.frombuffer(r["counts"], np.int32).astype(np.int64)
        counts[right.column("at").to_numpy()] = right.column("c").to_numpy()
        words = np.array(r["n_words"], np.int64)
        c = counts[unpack(r["codes"], "<u4")]
        doc = np.repeat(np.arange(len(words)), words)
        floor = np.log10(total + kinds + 1)
        known = np.bincount(doc, weights=c > 0, minlength=len(words)).astype(np.int64) + (training > 0)
        base = np.bincount(doc, weights=np.log10(c + 1.0) - floor, minlength=len(words)) + np.log10(training + 1.0) - floor
        return pa.table({"shard": pa.array([r["shard"]] * len(words), pa.int64()), "doc": np.arange(len(words), dtype=np.int32),
                         "doc_id": pa.array(r["doc_ids"], pa.int64()), "held_out": pa.array(r["held_out"], pa.bool_()),
                         "n_tokens": words + 1, "n_known": known, "base_score": base})

    # A shard knows its own counts; only words that others count too need an answer.
    answers = listed.where("c <> n").select("shard", "at", "c")
    payload = rows.select("shard", "doc_ids", "held_out", "n_words", "codes", "counts")
    return payload.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(score, BASE), total


def units_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit of every id, and log-probability of the id within its unit."""
    order = np.lexsort((np.arange(IDS), -counts))
    of = np.zeros(IDS, np.int32)
    of[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    share = np.cumsum(counts[rest] + 1.0)
    of[rest] = SINGLE + np.minimum(GROUPS - 1, (share - 1) * GROUPS / share[-1]).astype(np.int32)
    mass = counts + 1.0
    return of, np.log(mass / np.bincount(of, weights=mass, minlength=UNITS)[of]).astype(np.float32)


def like_units(follow: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Class of every unit: k-means of what the units follow and are followed by, in a few dimensions."""
    rng = np.random.default_rng(2)
    come = follow * (1.0 / np.maximum(follow.sum(axis=0), 1e-9))
    both = np.sqrt(np.hstack([follow, come.T])).astype(np.float32)
    axes = np.linalg.qr(both.T @ (both @ rng.standard_normal((both.shape[1], 24)).astype(np.float32)))[0]
    points = both @ axes
    centers, own = points[rng.choice(len(points), CLASSES, replace=False)], np.zeros(len(points), np.int32)
    for _ in range(rounds):
        own = ((centers**2).sum(axis=1)[None, :] - 2 * points @ centers.T).argmin(axis=1).astype(np.int32)
        for c in np.unique(own):
            centers[c] = points[own == c].mean(axis=0)
    return own


def neighbour_logs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of a unit, log-probability of a class after a unit, log-probability of a unit after a unit given its class).

    Counts of pairs back off to those of single units (Witten and Bell).
    """
    alone = pairs.sum(axis=0) + 1.0
    alone /= alone.sum()
    n, kinds = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True)
    follow = (pairs + (kinds + 1e-3) * alone) / (n + kinds + 1e-3)
    of = like_units(follow)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(CLASSES))
    used = np.unique(of)
    groups = np.full((UNITS, CLASSES), 1e-30)
    groups[:, used] = np.add.reduceat(follow[:, order], first[used], axis=1)
    return of, np.log(groups).astype(np.float32), np.log(follow / groups[:, of]).astype(np.float32)


def training_stream(row: dict) -> list[np.ndarray]:
    ids, ends = unpack(row["ids"], "<u2"), np.cumsum(row["n_ids"])
    return [ids[e - n : e] for e, n, out in zip(ends, row["n_ids"], row["held_out"]) if not out]


def counted(rows: DataFrame, size: int, numbers: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each of `size` numbers stands in `numbers(ids of training texts)`, where the ids follow an end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                stream = np.concatenate([np.array([END], "<u2"), *training_stream(row)])
                for s in range(0, len(stream) - 1, 1 << 20):
                    total += np.bincount(numbers(stream[s : s + (1 << 20) + 1]), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch({"at": used.astype(np.int32), "n": total[used]})

    got = (rows.select("ids", "n_ids", "held_out").mapInArrow(run, "at int, n bigint").groupBy("at")
           .agg(F.sum("n").alias("n")).toArrow())  # at most `size` rows
    out = np.zeros(size, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def windows_of(texts: list[np.ndarray], of: np.ndarray, choose: Callable[[int], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Units and units before of WINDOW places; ids to predict, text number and whether to count of the last FRESH places;
    and whether the window begins its text, so that its first OVERLAP places stand before the text.

    A text is read after an end; a window's places beyond its text are not counted. `choose` gives the numbers of the
    windows to make, of so many.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    stream = np.concatenate([x for t in texts for x in ([END, END], t)]).astype(np.int32)
    begin = np.cumsum(sizes + 2) - sizes - 2
    n = np.maximum(1, -(-sizes // FRESH))
    text = np.repeat(np.arange(len(texts)), n)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * FRESH
    if choose is not None:
        chosen = choose(len(text))
        text, start = text[chosen], start[chosen]
    place = start.astype(np.int32)[:, None] + np.arange(-OVERLAP, FRESH, dtype=np.int32)[None, :]
    past = sizes[text].astype(np.int32)[:, None]
    counts = place[:, OVERLAP:] < past
    np.minimum(place, past - 1, out=place)
    place[start == 0, :OVERLAP] = 0
    at = begin[text][:, None] + 1 + place
    units = of[stream].astype(np.uint16)
    return (np.take(units, at), np.take(units, at - 1), np.take(stream, at[:, OVERLAP:] + 1),
            np.broadcast_to(text[:, None], counts.shape), counts, start == 0)


class Attention:
    """The layer's parameters with forward, backward and Adam steps."""

    def __init__(self, neighbours: np.ndarray, parameters: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(1)
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        start = parameters or {
            "own": 0.1 * rng.standard_normal((UNITS, WIDTH)), "before": 0.1 * rng.standard_normal((UNITS, WIDTH)),
            "query": small(WIDTH, WIDTH), "distance": np.zeros(WINDOW, np.float32), "mix": small(2 * WIDTH, WIDTH), "shift": np.full(WIDTH, 0.1, np.float32),
            "out": np.zeros((WIDTH, CLASSES), np.float32)}
        # The parameters, their gradients and the moments are parts of four long arrays, which Adam runs through.
        self.values = np.concatenate([np.ravel(v) for v in start.values()]).astype(np.float32)
        self.shapes = {k: np.shape(v) for k, v in start.items()}
        self.p = self.parts(self.values)
        self.neighbours, self.odds = neighbours, np.exp(neighbours)
        self.kept: dict[str, np.ndarray] = {}
        gap = np.arange(OVERLAP, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        self.causal, self.gap = gap >= 0, np.maximum(gap, 0)
        self.moments = np.zeros((0, 0), np.float32)
        self.steps = 0

    def parts(self, values: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[k], at = values[at : at + size].reshape(shape), at + size
        return out

    def room(self, name: str, *shape: int) -> np.ndarray:
        """A kept array: new ones of this size cost page faults."""
        if name not in self.kept or len(self.kept[name]) < shape[0]:
            self.kept[name] = np.empty(shape, np.float32)
        return self.kept[name][: shape[0]]

    def hidden(self, own: np.ndarray, before: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Attention of the last FRESH places of a batch of windows; `first`: nothing stands before these.

        Products of the query and key maps, and of the value map and mix, are one map each.
        """
        p, n = self.p, len(own)
        h, turned = self.room("h", n, WINDOW, WIDTH), self.room("turned", n, WIDTH, WINDOW)
        more, a = self.room("more", n, WINDOW, WIDTH), self.room("a", n, FRESH, WINDOW)
        q, o, z, y = (self.room(k, n, FRESH, WIDTH) for k in "qozy")
        np.take(p["own"], own, axis=0, out=h, mode="clip")
        h += np.take(p["before"], before, axis=0, out=more, mode="clip")
        np.copyto(turned, h.transpose(0, 2, 1))
        fresh = h[:, OVERLAP:]
        np.matmul(np.matmul(fresh, p["query"], out=q), turned, out=a)
        a += np.where(self.causal, p["distance"][self.gap], np.float32(-1e9))
        if first.any():
            a[first, :, :OVERLAP] = -1e9
        if n and a.max() > 60:
            np.minimum(a, np.float32(60), out=a)
        np.exp(a, out=a)
        a *= (1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32))).reshape(n, FRESH, 1)
        np.matmul(a, h, out=o)
        np.matmul(fresh, p["mix"][:WIDTH], out=z)
        z += np.matmul(o, p["mix"][WIDTH:], out=y)
        z += p["shift"]
        return {"h": h, "turned": turned, "q": q, "o": o, "a": a, "z": np.maximum(z, 0, out=z)}

    def weights(self, z: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(what the layer adds to the logarithms of the classes, the classes' weights after that, the sum of these)."""
        gain, odds = self.room("gain", len(z), CLASSES), self.room("odds", len(z), CLASSES)
        weight = self.room("weight", len(z), CLASSES)
        np.matmul(z, self.p["out"], out=gain)
        if len(z) and (gain.max() > 60 or gain.min() < -60):
            np.clip(gain, -60, 60, out=gain)
        np.exp(gain, out=weight)
        weight *= np.take(self.odds, own, axis=0, out=odds, mode="clip")
        return gain, weight, weight @ np.ones(CLASSES, np.float32)

    def gains(self, z: np.ndarray, own: np.ndarray, target: np.ndarray) -> np.ndarray:
        """What the layer adds to the log-probability of the target classes."""
        out = np.empty(len(z), np.float64)
        for i in range(0, len(z), ROWS):
            gain, _, total = self.weights(z[i : i + ROWS], own[i : i + ROWS])
            right = np.arange(0, gain.size, CLASSES) + target[i : i + ROWS]
            out[i : i + ROWS] = gain.take(right) - np.log(total.astype(np.float64))
        return out

    def logs(self, z: np.ndarray, own: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of the target classes."""
        return self.gains(z, own, target) + self.neighbours[own, target]

    def learn(self, own: np.ndarray, before: np.ndarray, target: np.ndarray, counts: np.ndarray, first: np.ndarray) -> None:
        """One Adam step on the counted places of a batch of windows."""
        self.find_slopes(own, before, target, counts, first)
        self.steps += 1
        # The moments are kept without the factors 0.1 and 0.01 of each new term.
        some = np.sqrt(0.01 / (1 - 0.99**self.steps))
        rate, least = np.float32(STEP * 0.1 / (1 - 0.9**self.steps) / some), np.float32(1e-8 / some)
        for i in range(0, len(self.values), STRETCH):
            (m, r, slope), v = self.moments[:, i : i + STRETCH], self.values[i : i + STRETCH]
            m *= np.float32(0.9)
            m += slope
            r *= np.float32(0.99)
            r += np.multiply(slope, slope, out=slope)
            step = np.sqrt(r, out=slope)
            step += least
            np.divide(m, step, out=step)
            step *= rate
            v -= step

    def find_slopes(self, own: np.ndarray, before: np.ndarray, target: np.ndarray, counts: np.ndarray, first: np.ndarray) -> None:
        """Gradients of the mean loss of the counted places, added up part by part."""
        if not len(self.moments):
            self.moments = np.zeros((3, len(self.values)), np.float32)
            self.slopes = self.parts(self.moments[2])
        p, g, places = self.p, self.slopes, max(1, int(counts.sum()))
        dh = self.room("dh", len(own), WINDOW, WIDTH)
        for k in ("query", "mix", "shift", "out"):
            g[k][...] = 0
        near = np.zeros((FRESH, WINDOW), np.float32)
        for i in range(0, len(own), PART):
            part = slice(i, i + PART)
            near += self.slope(dh[part], own[part], before[part], target[part], counts[part] / np.float32(places), first[part])
        g["distance"][...] = np.bincount(self.gap[self.causal], weights=near[self.causal], minlength=WINDOW)
        pairs = dh.reshape(-1, WIDTH)
        for name, at in (("own", own), ("before", before)):
            at = at.astype(np.uint16).ravel()  # 16 bits are sorted by digits
            order = np.argsort(at, kind="stable")
            keys = at[order]
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            rows = np.take(pairs, order, axis=0, out=self.room("more", *dh.shape).reshape(-1, WIDTH), mode="clip")
            g[name][...] = 0
            # Two numbers are added at a time as one complex number.
            g[name][keys[begin]] = np.add.reduceat(rows.view(np.complex64), begin, axis=0).view(np.float32)

    def slope(self, dh: np.ndarray, own: np.ndarray, before: np.ndarray, target: np.ndarray, share: np.ndarray,
              first: np.ndarray) -> np.ndarray:
        """Adds to the gradients of the maps; puts that of the inputs into `dh`; returns that of the attention's logits, summed.

        `share` is what a place counts for.
        """
        p, g, s, n = self.p, self.slopes, self.hidden(own, before, first), len(own)
        back = np.ascontiguousarray(np.concatenate([p["mix"][:WIDTH], p["query"]], axis=1).T)
        h, a, z = s["h"], s["a"], s["z"].reshape(-1, WIDTH)
        _, weight, total = self.weights(z, own[:, OVERLAP:].reshape(-1))
        right = np.arange(0, weight.size, CLASSES) + target.reshape(-1)
        weight.reshape(-1)[right] = weight.take(right) - total
        scale = (share.reshape(-1) / total)[:, None]
        flat = self.room("flat", len(z), WIDTH)
        g["out"] += summed(np.multiply(z, scale, out=flat).reshape(n, FRESH, WIDTH), weight.reshape(n, FRESH, CLASSES))
        np.matmul(weight, np.ascontiguousarray(p["out"].T), out=flat)
        flat *= scale
        both, fresh, y = self.room("both", n, FRESH, 2 * WIDTH), h[:, OVERLAP:], s["z"]  # slopes behind mix and query
        dz = np.multiply(flat.reshape(n, FRESH, WIDTH), s["z"] > 0, out=both[:, :, :WIDTH])
        g["mix"][WIDTH:] += summed(s["o"], dz)
        do = np.matmul(dz, np.ascontiguousarray(p["mix"][WIDTH:].T), out=y)
        np.matmul(a.transpose(0, 2, 1), do, out=dh)
        da = np.matmul(do, s["turned"], out=self.room("da", n, FRESH, WINDOW))
        do *= s["o"]
        da -= (do.reshape(-1, WIDTH) @ np.ones(WIDTH, np.float32)).reshape(n, FRESH, 1)  # the mean of da under a
        da *= a
        dh += np.matmul(da.transpose(0, 2, 1), s["q"], out=self.room("more", n, WINDOW, WIDTH))
        np.matmul(da, h, out=both[:, :, WIDTH:])
        sides = summed(fresh, both)
        g["mix"][:WIDTH] += sides[:, :WIDTH]
        g["query"] += sides[:, WIDTH:]
        g["shift"] += (np.ones(n * FRESH, np.float32) @ both.reshape(-1, 2 * WIDTH))[:WIDTH]
        dh[:, OVERLAP:] += np.matmul(both, back, out=y)
        return da.sum(axis=0)


def summed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum over the windows of left transposed times right; windows are joined in blocks, which leaves fewer terms."""
    blocks = len(left) // gcd(len(left), 8)
    left, right = (x.reshape(blocks, -1, x.shape[-1]) for x in (left, right))
    return np.matmul(left.transpose(0, 2, 1), right).sum(axis=0)


def windows_of_round(count: int, shard: int, start: int, number: int, rounds: int = ROUNDS) -> np.ndarray:
    """Which of the windows that begin at text `start` of a shard are learned from in round `number`."""
    rng = np.random.default_rng([shard & 0xFFFFFFFF, start])
    return np.flatnonzero(rng.integers(0, rounds, count) == number)


def train(rows: DataFrame, of: np.ndarray, kind: np.ndarray, neighbours: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters, after rounds in which every task trains a copy on its windows and copies are averaged."""
    model = Attention(neighbours)
    context = rows.sparkSession.sparkContext
    for number in range(rounds):
        shared = context.broadcast((of, kind, neighbours, model.p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units, classes, logs, start = shared.value
            copy, seen, class_of = Attention(logs, start), 0, classes[units]
            for batch in batches:
                for row in batch.to_pylist():
                    texts = training_stream(row)
                    for s in range(0, len(texts), 256):
                        own, before, target, _, counts, first = windows_of(
                            texts[s : s + 256], units, lambda n: windows_of_round(n, row["shard"], s, number, rounds))
                        for i in range(0, len(own), BATCH):
                            c = slice(i, i + BATCH)
                            copy.learn(own[c], before[c], class_of[target[c]], counts[c], first[c])
                        seen += len(own)
            if seen:
                values = copy.values
                yield pa.record_batch({"at": np.arange(len(values), dtype=np.int32), "v": values * np.float64(seen),
                                       "n": np.full(len(values), seen, np.int64)})

        got = (rows.select("shard", "ids", "n_ids", "held_out").mapInArrow(run, "at int, v double, n bigint").groupBy("at")
               .agg((F.sum("v") / F.sum("n")).alias("v")).orderBy("at").toArrow())  # one row a parameter
        if got.num_rows:
            model = Attention(neighbours, model.parts(got.column("v").to_numpy()))
    return model.p


def scored_texts(model: Attention, texts: list[np.ndarray], units: np.ndarray, inside: np.ndarray, class_of: np.ndarray,
                 follow: np.ndarray) -> np.ndarray:
    """Log-probability of every text; `follow`: that of a unit after a unit, by counts, in one row."""
    own, before, target, text, counts, first = windows_of(texts, units)
    found = np.empty(len(own))
    for i in range(0, len(own), TOGETHER):
        c = slice(i, i + TOGETHER)
        z = model.hidden(own[c], before[c], first[c])["z"]
        x, y = own[c, OVERLAP:].reshape(-1).astype(np.int64), target[c].reshape(-1)
        places = model.gains(z.reshape(-1, WIDTH), x, class_of.take(y))
        places += follow.take(x * UNITS + units.take(y))
        places += inside.take(y)
        found[c] = np.einsum("nf,nf->n", places.reshape(-1, FRESH), counts[c])
    return np.bincount(text[:, 0], weights=found, minlength=len(texts))


def attention_scores(rows: DataFrame, tables: tuple[np.ndarray, ...], parameters: dict[str, np.ndarray]) -> DataFrame:
    """(shard, doc, score): log10 probability of every document.

    tables: unit of an id, log-probability of an id in its unit, class of a unit, log-probability of a class after a unit,
    and of a unit after a unit in one row.
    """
    shared = rows.sparkSession.sparkContext.broadcast((tables, parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (units, inside, classes, logs, follow), p = shared.value
        model, class_of = Attention(logs, p), classes[units]
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = unpack(row["ids"], "<u2"), np.array(row["n_ids"], np.int64)
                ends, score = np.cumsum(sizes), np.zeros(len(sizes))
                first = 0
                while first < len(sizes):
                    past = max(first + 1, int(np.searchsorted(ends, ends[first] + 65536)))
                    texts = [ids[e - n : e] for e, n in zip(ends[first:past], sizes[first:past])]
                    score[first:past] = scored_texts(model, texts, units, inside, class_of, follow)
                    first = past
                yield pa.record_batch({"shard": np.full(len(score), row["shard"], np.int64),
                                       "doc": np.arange(len(score), dtype=np.int32), "score": score / np.log(10)})

    return rows.select("shard", "ids", "n_ids").mapInArrow(run, "shard bigint, doc int, score double")


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    `docs` has doc_id, text and held_out; the rows that are not held out are learned from.
    """
    rows = materialise(shards(docs), "shards")
    of, within = units_of(counted(rows, IDS, lambda ids: ids[1:]))

    def pairs(ids: np.ndarray) -> np.ndarray:
        units = of[ids].astype(np.int64)
        return units[:-1] * UNITS + units[1:]

    kind, neighbours, after = neighbour_logs(counted(rows, UNITS**2, pairs).reshape(UNITS, UNITS).astype(np.float64))
    parameters = train(rows, of, kind, neighbours)
    follow = (after + neighbours[:, kind]).ravel()
    scored = materialise(attention_scores(rows, (of, within, kind, neighbours, follow), parameters), "scores")
    base, total = base_scores(rows)
    return base.join(scored, ["shard", "doc"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
