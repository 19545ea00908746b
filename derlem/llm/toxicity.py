"""Toxicity by compression distance.

Two dictionaries are trained with zstandard, each on its own class: one on the windows of ordinary texts, one on the windows of toxic
texts, a window being three words. A document's windows are compressed with each of them alone, and the difference of both lengths says which
class explains a window better: the largest difference of a document, and the numbers of windows whose difference reaches two thresholds,
are what a logistic curve scores. Short windows and short segments (``k`` of the trainer) matter: most of a toxic document is ordinary text,
and long segments carry it into the toxic dictionary (figures in README).

An addition that isn't a trained dictionary: stretches, runs of bytes across words that significantly more toxic documents than ordinary ones
have. Windows of four words that share a run with a stretch are compressed with an ordinary dictionary, and with it and the stretches; what the stretches save gives the curve
three more numbers of the same kind.

The curve is fitted on documents that neither dictionaries nor stretches have seen.

Learning takes a sample bounded by TrainingBound, whose classes count as often as all labels have them; scoring takes every whole text.
Only labels of the training fold are read.

Defined cases: null and empty texts get the score of a document without gains; a label without a document, or a null label, is left
out; a document labelled twice is toxic if one label says so; of rows that repeat a doc_id one is learnt from, and exact copies count
once for the dictionaries; without toxic or ordinary training rows every score is the smoothed base rate; repeated and null doc_ids are
scored like any row (null ids are in neither fold's training); empty tables give empty ones; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lookup_join, table

#: Words of a window for the pair of trained dictionaries; bytes that the toxic one must save more than the ordinary one to count, and to be far.
PAIR_WORDS = 3
APART, FAR = 4, 5
#: (bytes, segments of so many bytes) of the ordinary and the toxic trained dictionary; the trainer counts runs of TRAINED_RUN bytes.
TRAINED = ((112_640, 32), (8_000, 10))
TRAINED_RUN = 6
#: The addition's windows.
WINDOW_WORDS = 4
#: Bytes by which the toxic dictionary must shorten a window to count, and to count as a large gain.
GAIN, LARGE = 2, 4
THRESHOLD = 0.7
#: Share of labels taken to be wrong, either way: where gains part the classes, it bounds the curve, which the sample's size would else make steep.
DOUBT = 0.01
#: Bytes of a run, which is also the shortest match of the compressors, and of the text that follows each window.
RUN, PAD = 6, 32


@dataclass(frozen=True)
class TrainingBound:
    """What is learnt from, at most: toxic and ordinary rows, for dictionaries and curve together; characters of a text (longer ones are
    left out of learning); bytes of the addition's ordinary dictionary; bytes of windows that each dictionary is trained on."""

    toxic: int = 2000
    ordinary: int = 4000
    chars: int = 20_000
    dictionary: int = 16_000
    samples: int = 12 << 20


#: Bytes of toxic dictionaries that are tried, and from how many times as large a one their best end is taken; the calibration rows choose.
TOXIC_DICTIONARIES = ((400, 2), (1600, 8), (3200, 8))


@dataclass(frozen=True)
class Model:
    """pair: the trained ordinary and toxic dictionary; ordinary and toxic: what the addition compresses with; weights: of the curve, the
    intercept, three for the addition, three for the pair."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    pair: tuple[bytes, bytes] = (b"", b"")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _spaced(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def windows(text: str | None, words: int = PAIR_WORDS) -> list[bytes]:
    split = _words(text)
    return [_spaced(split[i : i + words]) for i in range(0, len(split), words)]


def train_pair(ordinary: list[str], toxic: list[str], most: int) -> tuple[bytes, bytes]:
    """A dictionary of each class, as zstandard trains it on the windows of the class's texts; none if one has too little text to train on."""
    made = []
    for texts, (size, k) in zip((ordinary, toxic), TRAINED, strict=True):
        samples, held = [], 0
        for text in sorted(set(texts), key=lambda t: (text_hash(t), t)):
            samples += windows(text)
            held += len(text)
            if held > most:
                break
        try:
            made.append(zstandard.train_dictionary(size, samples, k=k, d=TRAINED_RUN).as_bytes())
        except (zstandard.ZstdError, ValueError):
            return b"", b""
    return made[0], made[1]


@lru_cache(maxsize=4)
def differences(ordinary: bytes, toxic: bytes):
    """text -> (largest difference of a window, windows APART or more, windows FAR or more)."""
    if not (ordinary and toxic):
        return lambda text: (0, 0, 0)
    size = max(len(ordinary), len(toxic))
    by_ordinary, by_toxic = (_compressor(zstandard.ZstdCompressionDict(x), 6, size, 4) for x in (ordinary, toxic))
    pad = b" " * PAD

    def of(text: str | None) -> tuple[int, int, int]:
        most = n = far = 0
        for window in windows(text):
            apart = len(by_ordinary(window + pad)) - len(by_toxic(window + pad))
            if apart >= APART:
                most, n, far = max(most, apart), n + 1, far + (apart >= FAR)
        return most, n, far

    return of


def _runs(data: bytes) -> np.ndarray:
    """The run that begins at each byte, as a number."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = max(0, len(x) - RUN + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(RUN):
        out = (out << np.uint64(8)) | x[j : j + n]
    return out


def toxic_stretches(toxic: list[str], ordinary: list[str], z: float = 6.0, purity: float = 0.05, least: int = 3) -> list[bytes]:
    """Stretches of toxic texts made of runs whose share of toxic documents exceeds that of ordinary ones by z standard errors, and is 1/purity times as high."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    texts = [_spaced(_words(t)) for t in toxic]
    runs = [_runs(x) for x in texts]
    known, n = np.unique(np.concatenate([np.unique(r) for r in runs]), return_counts=True)
    known, n = known[n >= least], n[n >= least]
    other = np.zeros(len(known), dtype=np.int64)
    for t in ordinary:
        other[np.isin(known, np.unique(_runs(_spaced(_words(t)))), assume_unique=True)] += 1
    a, b = n / len(toxic), other / len(ordinary)
    share = (n + other) / (len(toxic) + len(ordinary))
    apart = a - b > z * np.sqrt(share * (1 - share) * (1 / len(toxic) + 1 / len(ordinary)))
    pure = known[apart & ((other + 0.5) / len(ordinary) < np.maximum(purity, 0.6 / a / len(ordinary)) * a)]
    out = []
    for x, r in zip(texts, runs, strict=True):
        begin = np.flatnonzero(np.isin(r, pure))
        cover = np.zeros(len(x) + 1, dtype=np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + RUN, -1)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            # One or two letters of a neighbouring word at either end say nothing of the stretch.
            while 0 < x.find(b" ", i, j) - i < 3:
                i = x.find(b" ", i, j)
            while 0 < j - 1 - x.rfind(b" ", i, j) < 3 and x.rfind(b" ", i, j) >= 0:
                j = x.rfind(b" ", i, j) + 1
            if j - i >= RUN:
                out.append(x[i:j])
    return out


def _train_dictionary(samples: list[bytes], size: int, times: int, k: int, d: int) -> bytes:
    """The last bytes, which hold the best segments, of a larger dictionary; samples that fit as they are need no choice: the commonest go last."""
    whole = b"".join(s for s, _ in sorted(Counter(samples).items(), key=lambda p: (p[1], p[0])))
    if len(whole) <= size:
        return whole
    try:
        return zstandard.train_dictionary(times * size + 512, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to train on
        return whole[-size:]


def _raw(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _compressor(dictionary: zstandard.ZstdCompressionDict, level: int, size: int, shortest: int):
    p = zstandard.ZstdCompressionParameters.from_level(level, source_size=128, dict_size=size, min_match=shortest, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    dictionary.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=p).compress


@lru_cache(maxsize=4)
def gains(ordinary: bytes, toxic: bytes):
    """text -> (largest gain, windows with a gain, windows with a large gain): the features of a document."""
    if not toxic:
        return lambda text: (0, 0, 0)
    # Zstandard starts no match in the last bytes and stores very short inputs as they are, so each window has the same text after it.
    # Nor does it look for matches in the last eight bytes of a dictionary.
    one, both, pad = ordinary + b" " * 8, ordinary + toxic + b" " * 8, (b" " * PAD + ordinary)[-PAD:]
    size = len(both)  # the same tables for both, whatever they hold
    short_o, short_t = _compressor(_raw(one), 6, size, RUN), _compressor(_raw(both), 6, size, RUN)

    # Only a window that shares a run with the toxic part can gain by it; the others aren't compressed. A table by hash says which may share one.
    known = np.unique(_runs(ordinary[1 - RUN :] + toxic + b" " * 8))
    spread = lambda runs: (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
    marked = np.zeros(1 << 18, dtype=bool)
    marked[spread(known)] = True

    def of(text: str | None) -> tuple[int, int, int]:
        words = _words(text)
        runs = _runs(_spaced(words))
        at = np.flatnonzero(marked[spread(runs)])
        at = at[np.isin(runs[at], known)]
        if not len(at):
            return 0, 0, 0
        # Where in the text each window starts: at the blank before its first word.
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)))[:-1:WINDOW_WORDS]
        most = n = large = 0
        own = np.searchsorted(starts, at, side="right") - 1
        inside = at + RUN <= np.append(starts[1:] + 1, len(runs) + RUN - 1)[own]
        for i in np.unique(own[inside]).tolist():
            window = _spaced(words[i * WINDOW_WORDS : (i + 1) * WINDOW_WORDS]) + pad
            gain = len(short_o(window)) - len(short_t(window))
            if gain >= GAIN:
                most, n, large = max(most, gain), n + 1, large + (gain >= LARGE)
        return most, n, large

    return of


def _features(rows: np.ndarray) -> np.ndarray:
    """rows: gains, then differences."""
    most, n, large, apart, m, far = rows.T
    return np.stack([np.ones(len(rows)), np.maximum(0, most - GAIN) / 5, np.log1p(n), np.log1p(large), np.maximum(0, apart - APART + 1) / 5, np.log1p(m), np.log1p(far)], axis=1)


def _found(model: Model, texts: Iterable) -> np.ndarray:
    """texts: strings, or the values of an Arrow column, of which one at a time becomes a string."""
    gain, apart = gains(model.ordinary, model.toxic), differences(*model.pair)
    plain = (t.as_py() if isinstance(t, pa.Scalar) else t for t in texts)
    return np.array([(*gain(t), *apart(t)) for t in plain], dtype=float).reshape(-1, 6)


def _scores(model: Model, found: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(found) @ np.array(model.weights), -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.00002, rows: np.ndarray | None = None) -> tuple[float, ...]:
    """Logistic regression by Newton's method; the intercept isn't shrunk, and no gain lowers a score. rows: how much each row counts, 1 by
    default. ridge: for each row, so that the curve doesn't grow steeper with the sample."""
    w, rows = np.zeros(x.shape[1]), np.ones(len(y)) if rows is None else rows
    penalty = np.diag([1e-6, *[ridge * rows.sum()] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (rows * (y - p)) - penalty @ w
        free = (w > 0) | (slope > 0)  # a weight that would go below zero stays there, and the others are solved without it
        free[0] = True
        curve = (x * (rows * p * (1 - p))[:, None]).T @ x + penalty
        while True:
            step = np.zeros(x.shape[1])
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
            below = (w <= 0) & (step < 0)
            below[0] = False
            if not below.any():
                break
            free &= ~below
        w = w + np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: TrainingBound = TrainingBound()) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic): learns from rows of the training fold only."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = durable(known, "known")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(n) for t, n in ((1, bound.toxic), (0, bound.ordinary))]
    picked = durable(chosen[0].unionByName(chosen[1]), "training")
    texts = docs.select("doc_id", "text").where(F.length("text") <= bound.chars)
    texts = lookup_join(texts, picked, "doc_id", "inner", rows=bound.toxic + bound.ordinary)
    # One row for each picked id, whatever its rows: at most bound.toxic + bound.ordinary texts of at most bound.chars characters.
    rows = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("doc_id").collect()
    parts = {(t, c): [r["text"] for r in rows if r["toxic"] == t and (text_hash(r["text"]) % 3 == 0) == c] for t in (0, 1) for c in (False, True)}
    toxic, ordinary = parts[1, False], parts[0, False]
    # A class that hit its bound stands for more rows than it has here: its rows count as many times as it has labels for each one picked.
    stands = np.array([max(1.0, counts.get(t, 0) / n) for t, n in ((0, bound.ordinary), (1, bound.toxic))])
    y = np.array([t for t in (0, 1) for _ in parts[t, True]], dtype=float)
    both = bool(toxic) and bool(ordinary) and 0 < y.sum() < len(y)
    stretches = toxic_stretches(toxic, ordinary) if both else []
    pair = train_pair(ordinary, toxic, bound.samples) if both else (b"", b"")
    if not stretches and not pair[0]:
        have = np.bincount([r["toxic"] for r in rows], minlength=2) * stands
        have = have * len(rows) / max(1.0, have.sum())
        rate = (have[1] + 0.5) / (len(rows) + 1)
        return Model(b"", b"", (float(np.log(rate / (1 - rate))), *[0.0] * 6))
    rows_each = stands[y.astype(int)]
    rows_each = rows_each * len(y) / rows_each.sum()
    by_ordinary = _train_dictionary([_spaced(_words(t)) for t in ordinary], bound.dictionary, 4, 64, 8)
    models = []
    for size, times in TOXIC_DICTIONARIES if stretches else ((0, 0),):
        model = Model(by_ordinary, _train_dictionary(stretches, size, times, 16, RUN), (), pair)
        x = _features(_found(model, [text for t in (0, 1) for text in parts[t, True]]))
        weights = _fit(x, DOUBT + (1 - 2 * DOUBT) * y, rows=rows_each)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ np.array(weights), -30, 30))), 1e-6, 1 - 1e-6)
        models.append((float(-(rows_each * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()), size * times, replace(model, weights=weights)))
    return min(models, key=lambda m: m[:2])[2]


def text_hash(text: str) -> int:
    """Rows for the curve are chosen by text, so that no copy of them is among the texts that dictionaries are trained on."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, gain (the addition's largest), gaining (windows), apart (the pair's largest difference)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _found(model, batch.column(1))
            more = [pa.array(found[:, i].astype(np.int32)) for i in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, found)), *more], names=["doc_id", "score", "gain", "gaining", "apart"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, gain int, gaining int, apart int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score the threshold or more go; the others keep all columns. Each row is judged by its own text, without a shuffle."""
    schema, names = docs.schema, docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):  # what is copied at a time stays small beside the batch
                part = batch.slice(i, 500)
                yield part.filter(pa.array(_scores(model, _found(model, part.column(at))) < threshold))

    return docs.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
