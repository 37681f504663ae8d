"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled rows: one on ordinary text,
one on ordinary text plus the vocabulary that sets toxic text apart. Every
window of a text is compressed with both. Where the toxic dictionary saves
bytes, the window holds toxic wording; how many bytes, and in how many windows,
is turned into a probability by thresholds and weights calibrated on labelled
rows that neither dictionary has seen.

Learning takes a bounded sample of rows (SAMPLE toxic and twice as many ordinary
ones), each with its whole text: words are counted and calibration features
taken over all of it, in Spark tasks. Only the ordinary dictionary, whose size is
fixed, is trained on SAMPLE_WINDOWS windows a row, spread evenly from the first
to the last. Scoring compresses every window of every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.text import column, constants, each, mix, ngrams, word_hashes
from cairn.session import bound_batches, materialize

#: Toxic rows that are learned from at most, and windows of a row that train the ordinary dictionary.
SAMPLE, SAMPLE_WINDOWS = 3000, 20
WINDOW, LEVEL = 8, 3
ORDINARY_BYTES, TOXIC_BYTES = 32768, 4096
#: A constant start of every window, so that each is long enough to be compressed at all.
PAD = b"0123456789" * 8
THRESHOLD = 0.7
#: A word is toxic vocabulary if so many more of the toxic than of the ordinary rows hold it.
LIFT, SHARE = 20, 0.03


def windows(text: str | None) -> list[bytes]:
    ws = text.encode().lower().split() if text else []
    return [PAD + b" " + b" ".join(ws[i : i + WINDOW]) for i in range(0, len(ws), WINDOW)]


def _content(samples: list[bytes], size: int) -> bytes:
    """What a trained dictionary holds, without its header; few samples are taken as they are."""
    try:
        raw = zstd.train_dictionary(size, samples).as_bytes()
        start = raw.find(b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00")  # the repeat offsets that end a header
        return raw[start + 12 :] if start >= 0 else raw
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    if len(content) < 8:
        return zstd.ZstdCompressor(level=LEVEL, write_content_size=False)
    # the last bytes of a dictionary cannot start a match: the pad stands there
    d = zstd.ZstdCompressionDict(content + PAD, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(7))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(6))
    scale: np.ndarray = field(default_factory=lambda: np.ones(6))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, a window each."""
        if not hasattr(self, "_pair"):
            self._pair = _compressor(self.ordinary).compress, _compressor(self.ordinary + self.toxic).compress
        a, b = self._pair
        ws = windows(text)
        return np.fromiter((len(a(w)) - len(b(w)) for w in ws), float, len(ws))

    def features(self, text: str | None) -> np.ndarray:
        d = self.savings(text)
        n = len(d)
        if not n:
            return np.zeros(6)
        top = np.sort(d)[::-1]
        return np.array([min(top[0], 8), min(top[: max(1, n // 20)].mean(), 8), d.mean(), np.sqrt((d >= 3).mean()), np.sqrt((d >= 5).mean()), np.log1p((d >= 4).sum())])

    def score(self, text: str | None) -> float:
        x = (self.features(text) - self.centre) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _keys(ws: list[bytes]) -> list[int]:
    """A text's eight smallest five-word shingles by eight hashes; one hash of a shorter text's words."""
    with np.errstate(over="ignore"):
        s = ngrams(word_hashes(ws), 5)
        return [int(mix(s * c).min()) for c in constants(8, 5)] if len(s) else word_hashes([b" ".join(ws)]).tolist()


def _spread(ws: list[bytes]) -> list[bytes]:
    """At most SAMPLE_WINDOWS windows of a text, spread evenly from its first to its last."""
    n = -(-len(ws) // WINDOW)
    at = range(n) if n <= SAMPLE_WINDOWS else np.linspace(0, n - 1, SAMPLE_WINDOWS).round().astype(int).tolist()
    return [b" ".join(ws[i * WINDOW : (i + 1) * WINDOW]) for i in at]


def _apart(keys: list[list[int]]) -> list[int]:
    """Places of the texts to learn from, near copies left out: texts that share one of their keys."""
    seen, out = set(), []
    for i, ks in enumerate(keys):
        named = {(len(ks), j, k) for j, k in enumerate(ks)}
        if seen.isdisjoint(named):
            out.append(i)
        seen |= named
    return out


def _split(xs: list) -> tuple[list, list]:
    """Two thirds for the dictionaries, the rest for calibration."""
    return xs[: 2 * len(xs) // 3], xs[2 * len(xs) // 3 :]


def _bounds(n_toxic: int, n_ordinary: int) -> tuple[float, float]:
    """Toxic rows that must hold a word of the vocabulary, and the lift it must have."""
    return max(3, SHARE * n_toxic), min(LIFT, 2 + n_ordinary / 10)


def _dictionaries(counts: list[tuple[bytes, int, int]], n_toxic: int, n_ordinary: int, samples: list[bytes]) -> Model:
    """A model yet to be calibrated. counts: each word with the toxic and the ordinary rows that hold it."""
    least, much = _bounds(n_toxic, n_ordinary)
    lifted = [(n, w) for w, n, m in counts if n >= least and (n + 0.1) / (n_toxic + 1) / ((m + 0.1) / (n_ordinary + 1)) >= much]
    vocabulary = [b" " + w for n, w in sorted(lifted) for _ in range(min(n, 50))]
    toxic = _content(vocabulary, TOXIC_BYTES // 2) if vocabulary else b""
    # training passes over words shorter than the pieces it counts: they follow, the commonest last
    toxic += b"".join(w for w in dict.fromkeys(vocabulary) if w not in toxic)
    return Model(_content(samples, ORDINARY_BYTES), toxic[-TOXIC_BYTES:])


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray, n_toxic: int, n_ordinary: int) -> Model:
    if len(y) and 0 < y.sum() < len(y):
        model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
        model.weights = _logistic((x - model.centre) / model.scale, y)
    else:
        share = (n_toxic + 0.5) / (n_toxic + n_ordinary + 1)
        model.weights = np.r_[np.log(share / (1 - share)), np.zeros(6)]
    return model


def fit_texts(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from two thirds of the rows, calibration from the rest."""
    t, o = ([xs[i] for i in _apart([_keys(_words(x)) for x in xs])] for xs in (toxic, ordinary))
    (t1, t2), (o1, o2) = _split(t), _split(o)
    ct, co = (Counter(w for x in xs for w in set(_words(x))) for xs in (t1, o1))
    model = _dictionaries([(w, n, co[w]) for w, n in ct.items()], len(t1), len(o1), [w for x in o1 for w in _spread(_words(x))])
    held = (t2 or t) + (o2 or o)
    x = np.array([model.features(s) for s in held]) if held else np.zeros((0, 6))
    return _calibrate(model, x, np.r_[np.ones(len(t2 or t)), np.zeros(len(o2 or o))], len(t), len(o))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    a = np.c_[np.ones(len(x)), x]
    w, keep = np.zeros(a.shape[1]), np.r_[1e-6, np.full(x.shape[1], ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` labelled rows a class, none of them held out.

    The rows are those with the smallest hash of their id, so a rerun learns the
    same, and their texts are learned from whole. Labels that are null, or whose
    document is missing, teach nothing; of rows that repeat an id, the smallest text.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(2 * sample))
    # at most 3 * sample ids: a bounded broadcast
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = materialize(rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.min(F.col("text").cast("string")).alias("text")), "labelled")

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [_words(t) for t in column(b, "text")]
            spread = [[] if c else _spread(x) for x, c in zip(ws, column(b, "toxic"), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([_keys(x) for x in ws], pa.list_(pa.uint64())).cast(pa.list_(pa.int64()), safe=False), pa.array(spread, pa.list_(pa.binary()))], ["doc_id", "toxic", "keys", "spread"])

    # eight numbers a row, and a bounded number of windows, cross to the driver
    got = rows.mapInArrow(outline, "doc_id long, toxic int, keys array<bigint>, spread array<binary>").toPandas()
    got = got.assign(k=pd.util.hash_array(got["doc_id"].to_numpy(np.int64))).sort_values(["k", "doc_id"], ignore_index=True) if len(got) else got
    sides = [got[got["toxic"] == c] for c in (1, 0)]
    t, o = (x.iloc[_apart(x["keys"].tolist())] for x in sides)
    (t1, t2), (o1, o2) = (_split(x["doc_id"].tolist()) for x in (t, o))
    learn, held = {*t1, *o1}, {*(t2 or t1), *(o2 or o1)}
    least, much = _bounds(len(t1), len(o1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ct, co = Counter(), Counter()
            for i, c, x in zip(*(column(b, n) for n in ("doc_id", "toxic", "text")), strict=True):
                if i in learn:
                    (ct if c else co).update(set(_words(x)))
            ws = list(ct | co)
            yield pa.record_batch([pa.array(ws, pa.binary()), pa.array([ct[w] for w in ws], pa.int64()), pa.array([co[w] for w in ws], pa.int64())], ["word", "t", "o"])

    counts = rows.mapInArrow(count, "word binary, t long, o long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    # only words of the vocabulary cross to the driver, with a margin for the last digit
    lift = (F.col("t") + 0.1) / (len(t1) + 1) / ((F.col("o") + 0.1) / (len(o1) + 1))
    words = [(bytes(r["word"]), r["t"], r["o"]) for r in counts.where((F.col("t") >= least) & (lift >= much * 0.999)).collect()]
    samples = [bytes(w) for x in o["spread"].iloc[: len(o1)] for w in x]
    model = _dictionaries(words, len(t1), len(o1), samples)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(i, c, x) for i, c, x in zip(*(column(b, n) for n in ("doc_id", "toxic", "text")), strict=True) if i in held]
            yield pa.record_batch([pa.array([r[0] for r in kept], pa.int64()), pa.array([r[1] for r in kept], pa.int64()), pa.array([model.features(r[2]).tolist() for r in kept], pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    # in the order of the ids, so that sums are added up alike on every run
    at = sorted(tuple(r) for r in rows.mapInArrow(measure, "doc_id long, toxic long, x array<double>").collect()) if held else []
    x = np.array([r[2] for r in at]) if at else np.zeros((0, 6))
    return _calibrate(model, x, np.array([r[1] for r in at], float), len(t), len(o))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: id_col, score (0 to 1), predicted (1 from THRESHOLD on) and the carried columns.

    A null or empty text has no window and gets the score of a text in which no
    dictionary saves anything. Each input row gives one row, so repeated rows
    give equal rows; an empty table gives an empty one. Columns that are not carried,
    whatever they are called, are not read. Ids may be of any type here; fit needs
    whole numbers.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    names = [f for f in rows.columns if f != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shared.value.score(t) for t in each(b, "_text")]
            yield pa.record_batch([*[b.column(n) for n in names], pa.array(s, pa.float64())], [*names, "score"])

    schema = rows.select(*names).schema.add("score", "double")
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)])
