"""Toxicity by compression distance.

Marks are the runs of characters that toxic documents have, or repeat, and ordinary ones
hardly ever do.  There are three zstandard dictionaries: one trained on ordinary text, one of the marks
that tell by their presence, and one of those that tell by being repeated (word stems that
ordinary documents hold once).  Each window of a text is compressed with the ordinary
dictionary alone and with those of the marks added to it; the bytes that either of
these saves are the window's gains.  Thresholds on gains are calibrated on labelled
documents: a logistic model of the greatest gains and of how many windows, and what share of
them, reach each threshold gives the score.  Calibration is on rows that did not train: the sample is
dealt into ``PARTS`` by hash of the text, and each part's gains come from dictionaries of the others.  In it a toxic
document counts ``TOXIC_WEIGHT`` times, so one missed weighs as much as so many false alarms.

Bounds: training reads at most ``SAMPLE`` labelled documents of each class, those
whose ids hash lowest, and none of over ``SAMPLE_CHARS`` characters; the ordinary dictionary is
trained on ``ORDINARY_WORDS`` words, drawn by hash from the whole sampled texts; dictionaries (``ORDINARY_BYTES``, ``TOXIC_BYTES``) and
coefficients are of fixed size.  Scoring goes through every window of every
text, row by row, without a shuffle.

Defined results: a null text counts as empty, and an empty text gets the score of a text
without any gain.  Where either class has no labelled document, all scores are
the share of toxic labels (0 without labels).  Labels of the same id count as toxic if any is.
Repeated rows get repeated results, an empty table an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_CHARS = 2500, 20_000
WINDOW, STRIDE = 30, 18
#: Lengths of grams, and how often a text may have to hold one.
GRAMS, REPEATS, LEAST_SEEN, LEAST_ODDS = (5, 6, 8, 10), (1, 2, 3, 4, 6), 4, 4.0
#: A mark grows by the letter beside it in this share of its words; marks inside words go on to so many characters.
GROWTH, LEAST_RUN = 0.8, 9
#: Of the hashes that find near copies.
SALTS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: Words that the ordinary dictionary is trained on, and bytes of it and of either dictionary of marks.
ORDINARY_WORDS, ORDINARY_BYTES, TOXIC_BYTES = 150_000, 8192, 2048
THRESHOLDS = (3, 4, 5, 6, 7, 8)
#: Chosen by recall and precision in either of the two training folds, trained on the other one; never on held-out rows.
PARTS, TOXIC_WEIGHT = 4, 3.0
_EDGE = ".,!?;:\"'()[]"
_PARAMETERS = dict(compression_level=5, window_log=14, min_match=5, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


@dataclass
class Model:
    """Dictionary contents, and the coefficients of the logistic model over features()."""

    ordinary: str  # latin-1
    toxic: str
    repeated: str
    weights: list[float]

    def dumps(self) -> str:
        return json.dumps(asdict(self))


def _words(text: str) -> list[str]:
    return [f" {w.strip(_EDGE)} " for w in text.lower().split()]


def _grams(word: str) -> set[str]:
    return {word[i : i + n] for n in GRAMS for i in range(len(word) - n + 1)}


def _dictionary(samples: list[str], size: int) -> bytes:
    """The content of a dictionary trained on samples; where they are too few to train on, the samples themselves."""
    if not samples:
        return b""
    grouped = ["".join(samples[i : i + 8]).encode() for i in range(0, len(samples), 8)]
    try:
        trained = zstandard.train_dictionary(size, grouped).as_bytes()
        return trained[-(size * 15 // 16) :]  # without the header and its entropy tables
    except zstandard.ZstdError:
        return "".join(dict.fromkeys(samples)).encode()[:size]


def _repeats(texts: list[str], grams_of: Callable[[str], set[str]]) -> Iterator[Counter]:
    """For each text, how many of its words hold each gram that grams_of finds in them."""
    known: dict[str, set[str]] = {}
    for t in texts:
        here: Counter = Counter()
        for w, k in Counter(_words(t)).items():
            if w not in known:
                known[w] = grams_of(w)
            for g in known[w]:
                here[g] += k
        yield here


def _levels(texts: list[str], grams_of: Callable[[str], set[str]]) -> Counter:
    """In how many texts each gram occurs at least so often, by gram and level of REPEATS."""
    count: Counter = Counter()
    for here in _repeats(texts, grams_of):
        for g, k in here.items():
            for r in REPEATS:
                if k < r:
                    break
                count[g, r] += 1
    return count


def _families(texts: list[str]) -> list[str]:
    """texts without those that share a least hash of 5-word runs with an earlier one: near copies are one piece of evidence."""
    met: list[set[int]] = [set() for _ in SALTS]
    out = []
    for t in texts:
        ws = t.lower().split()
        runs = {zlib.crc32(" ".join(ws[i : i + 5]).encode()) for i in range(max(1, len(ws) - 4))}
        least = [min(h * s & 0xFFFFFFFF for h in runs) for s in SALTS]
        if not any(h in m for h, m in zip(least, met, strict=True)):
            out.append(t)
        for h, m in zip(least, met, strict=True):
            m.add(h)
    return out


def marks(toxic: list[str], ordinary: list[str]) -> dict[str, int]:
    """The grams that tell toxic texts from ordinary ones, each with its level: how often a toxic text holds it at least.

    Each is the gram that reaches its level in the most toxic texts, not counting the words that earlier ones are part of.
    """
    toxic, ordinary = _families(toxic), _families(ordinary)
    least = LEAST_SEEN if len(toxic) >= 100 else 2
    base = math.log((len(toxic) + 1) / (len(ordinary) + 1))
    seen = _levels(toxic, _grams)
    wanted = {g for (g, _), n in seen.items() if n >= least}
    other = _levels(ordinary, lambda w: _grams(w) & wanted)
    levels: dict[str, list[int]] = {}
    for (g, r), n in seen.items():
        if n >= least and math.log((n + 0.5) / (other[g, r] + 0.5)) - base > LEAST_ODDS:
            levels.setdefault(g, []).append(r)
    holding: dict[str, dict[int, int]] = {}  # word: text: times
    of: dict[str, set[str]] = {}
    for i, t in enumerate(toxic):
        for w, k in Counter(_words(t)).items():
            if w not in of:
                of[w] = _grams(w) & levels.keys()
            if of[w]:
                holding.setdefault(w, {})[i] = k
    left = list(_repeats(toxic, lambda w: of[w]))
    reach = {(g, r): 0 for g, rs in levels.items() for r in rs}
    words: dict[str, set[str]] = {}
    for here in left:
        for g, k in here.items():
            for r in levels[g]:
                reach[g, r] += k >= r
    for w in holding:
        for g in of[w]:
            words.setdefault(g, set()).add(w)
    chosen: dict[str, int] = {}
    while reach:
        (gram, level), n = max(reach.items(), key=lambda q: (q[1], -len(q[0][0]), q[0]))
        if n < least:
            break
        chosen.setdefault(gram, level)
        for w in list(words[gram]):
            for i, k in holding[w].items():
                for g in of[w]:
                    before = left[i][g]
                    left[i][g] = before - k
                    for r in levels[g]:
                        reach[g, r] -= before >= r > before - k
            for g in of[w]:
                words[g].discard(w)
    return chosen


def _drawn(texts: list[str], chosen: dict[str, int]) -> list[str]:
    """ORDINARY_WORDS words of whole texts, those whose places hash lowest, in that order; none that holds a mark."""
    free: dict[str, bool] = {}  # what a mark saves must not be saved already

    def places() -> Iterator[tuple[int, int, int, str]]:
        for i, t in enumerate(texts):
            for j, w in enumerate(_words(t)):
                if w not in free:
                    free[w] = not any(g in w for g in chosen)
                if free[w]:
                    yield zlib.crc32(b"%d %d" % (i, j)), i, j, w

    return [p[3] for p in heapq.nsmallest(ORDINARY_WORDS, places())]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, bytes]:
    """Contents of the dictionaries of ordinary text, of present marks and of repeated ones, from texts of either class."""
    chosen = marks(toxic, ordinary)
    found: Counter = Counter()
    for t in toxic:
        found.update(_words(t))
    ordinary_samples = _drawn(ordinary, chosen)
    present, repeated = ([g for g, r in chosen.items() if (r > 1) == kind] for kind in (False, True))
    return _dictionary(ordinary_samples, ORDINARY_BYTES), _wording(found, present, TOXIC_BYTES), _wording(found, repeated, TOXIC_BYTES)


def trained(toxic: list[str], ordinary: list[str]) -> Model:
    """A model without coefficients."""
    return Model(*(x.decode("latin-1") for x in train_dictionaries(toxic, ordinary)), [])


def _wording(found: Counter, chosen: list[str], size: int) -> bytes:
    """Marks, grown by the letters beside them and then begun runs by turns, as many as go into size bytes; the first ones last, where matches are cheapest."""
    queues = []
    for g in chosen:
        words = {w: n for w, n in found.items() if g in w}
        while True:
            longer: Counter = Counter()
            for w, n in words.items():
                i = w.index(g)
                longer.update({w[max(0, i - 1) : i + len(g)]: n} if i else {})
                longer.update({w[i : i + len(g) + 1]: n} if i + len(g) < len(w) else {})
            best, n = max(longer.items(), key=lambda q: (q[1], q[0]), default=("", 0))
            if n < GROWTH * sum(words.values()):
                break
            g = best
            words = {w: n for w, n in words.items() if g in w}
        starts: Counter = Counter()
        for w, n in words.items():
            starts[w[w.index(g) :][: max(len(g), LEAST_RUN)]] += n
        queues.append([r for r, _ in sorted(starts.items(), key=lambda q: (-q[1], q[0]))])
    taken: dict[str, None] = {}
    room = size
    for turn in itertools.zip_longest(*queues):
        for r in turn:
            if r is not None and r not in taken and len(r.encode()) <= room:
                taken[r] = None
                room -= len(r.encode())
    return "".join(reversed(taken)).encode()


class Scorer:
    """Features and scores of texts under a model."""

    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)

        def compressor(content: bytes):
            content = content if len(content) >= 8 else b" " * 8
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress

        ordinary, toxic, repeated = (c.encode("latin-1") for c in (model.ordinary, model.toxic, model.repeated))
        self.plain, self.marked = compressor(ordinary), compressor(ordinary + repeated + toxic)
        self.kinds = [compressor(ordinary + c) for c in (toxic, repeated)]

    def features(self, text: str) -> np.ndarray:
        data = f" {text.lower()} ".encode()
        plain, marked = self.plain, self.marked
        windows = [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE)]
        n, of = len(windows), ([], [])
        for w in windows:
            size = len(plain(w))
            if size - len(marked(w)) >= THRESHOLDS[0]:
                for gains, compress in zip(of, self.kinds, strict=True):
                    gains.append(size - len(compress(w)))
        out = [1.0, math.log(n)]
        for gains in of:
            reach = [sum(g >= t for g in gains) for t in THRESHOLDS]
            out += [max(0, *gains) if gains else 0, *(math.log1p(k) for k in reach), *(math.sqrt(k / n) for k in reach)]
        return np.array(out)

    def score(self, text: str) -> float:
        if not len(self.weights):
            return 0.0
        if len(self.weights) == 1:
            return float(self.weights[0])
        return float(1 / (1 + math.exp(-max(-50.0, min(50.0, self.features(text) @ self.weights)))))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Coefficients of a logistic model, by Newton steps on the ridge-penalised weighted likelihood."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model fitted on a bounded sample of docs that labels marks 0 or 1."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    size = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}  # two rows
    total = sum(size.values())
    if len(size) < 2:
        return Model("", "", "", [size.get(1, 0) / total] if total else [])
    order = F.xxhash64(F.col(id_col))
    lowest = lambda kind: known.where(F.col("_toxic") == kind).orderBy(order).limit(SAMPLE)
    chosen = lowest(0).unionByName(lowest(1))  # 2 * SAMPLE rows at most
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    sample = docs.select(id_col, text).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), id_col).orderBy(id_col, "text").select("text", "_toxic").collect()
    by_class = [[r.text for r in sample if r["_toxic"] == k] for k in (0, 1)]
    if not all(by_class):
        return Model("", "", "", [size[1] / total])
    part = [zlib.crc32(r.text.encode()) % PARTS for r in sample]
    model = trained(by_class[1], by_class[0])
    others = [[[r.text for r, p in zip(sample, part, strict=True) if r["_toxic"] == k and p != own] for k in (0, 1)] for own in range(PARTS)]
    data = [(trained(x[1], x[0]) if all(x) else model).dumps() for x in others]
    spark = docs.sparkSession
    rows = spark.createDataFrame([(i, r.text, p) for i, (r, p) in enumerate(zip(sample, part, strict=True))], "i long, text string, part int").repartition(max(8, spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(Model(**json.loads(x))) for x in data]
        for batch in batches:
            found = [scorers[p].features(t).tolist() for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["i", "x"])

    features = {r.i: r.x for r in rows.mapInArrow(run, "i long, x array<double>").collect()}
    x = np.array([features[i] for i in range(len(sample))])
    y = np.array([r["_toxic"] for r in sample], float)
    share = np.where(y == 1, TOXIC_WEIGHT * size[1] / len(by_class[1]), size[0] / len(by_class[0]))
    model.weights = calibrate(x, y, share * len(y) / share.sum()).tolist()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dumps())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(**json.loads(shared.value)))
        for batch in batches:
            scores = [scorer.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def in_fold(id_col: str, fold: int = 1, folds: int = 3) -> Column:
    """True where crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
