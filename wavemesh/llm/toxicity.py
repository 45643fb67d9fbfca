"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary texts, one on toxic texts after what ordinary texts also say is
taken out of them. A window of a text, here each word in a fixed carrier, is compressed with the ordinary dictionary
and with both joined; how many bytes the toxic dictionary saves is the window's gain. What counts as a hit (the least
gain) and how the hits in a text make a score (a logistic curve over the logs of hits and words) are calibrated on
labelled texts that the dictionaries haven't seen.

Fitting takes a sample of the labelled rows, bounded by `SAMPLE` and `LONGEST`; scoring reads every word of every text.
A word's gain is computed once a task and kept, so frequent words cost a look-up.

Defined cases: a null or empty text scores like a text of no words; a doc_id with several labels counts as toxic if one
says so, one with several texts is learned from by the least of them, null labels are left out; without labels of both kinds the score is the share of toxic labels, 0 with none;
very long texts are scored whole, only fitting leaves out those of more than LONGEST characters;
repeated rows score alike; no rows give no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, shingle_set, small_batches

REJECT_FROM = 0.7
#: Labelled rows that fitting takes at most, by label; and the longest text, in characters, that it takes.
SAMPLE = {1: 3000, 0: 6000}
LONGEST = 20_000
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT = 32_768, 16_384, 50
#: A word is typical of toxic texts if its share of them is so many times its share of ordinary ones, and if so many of
#: them, and this share of them, have it: with open vocabularies, a few texts share some words by chance.
TYPICAL, LEAST_TEXTS, LEAST_SHARE = 20, 3, 0.007
GAINS, RESTS = (1, 2, 3, 4, 5, 6), (3, 5, 99)
KEPT_WORDS = 400_000


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    hit: tuple[int, int]
    weights: tuple[float, float, float]
    prior: float


class Gains(dict):
    """Of a word: the bytes that the toxic dictionary saves, and those that it needs."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        # every place of the dictionaries is a candidate, and matches from three bytes on are weighed by what they cost
        how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)

        def with_dictionary(content: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(compression_params=how, dict_data=d)

        self.without, self.with_toxic = with_dictionary(ordinary), with_dictionary(ordinary + toxic)
        # the word stands between two runs of known text: blocks this small aren't compressed, and the last bytes never matched
        self.ahead, self.behind = ordinary[-64:-32] + b" ", b" " + ordinary[-32:]
        self.empty = len(self.with_toxic.compress(self.ahead + self.behind))

    def __missing__(self, word: bytes) -> tuple[int, int]:
        window = self.ahead + word + self.behind
        a, b = len(self.without.compress(window)), len(self.with_toxic.compress(window))
        self[word] = found = (a - b, b - self.empty)
        return found


class Hits(dict):
    """Whether a word is a hit, kept up to a fixed count."""

    def __init__(self, model: Model):
        super().__init__()
        self.gains, (self.least, self.most) = Gains(model.ordinary, model.toxic), model.hit

    def __missing__(self, word: bytes) -> bool:
        if len(self) > KEPT_WORDS:
            self.clear()
        gain, rest = self.gains.__missing__(word)
        self.gains.clear()
        self[word] = hit = gain >= self.least and rest <= self.most
        return hit


def unlike(texts: list[str]) -> list[str]:
    """The texts without near copies of earlier ones: those that share the least or the greatest shingle hash."""
    seen: set[int] = set()
    kept = []
    for t in texts:
        s = shingle_set(t)
        ends = {int(s[0]), int(s[-1])} if len(s) else {0}
        if not ends & seen:
            kept.append(t)
        seen |= ends
    return kept


def train(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes] | None:
    """The two dictionaries; none if the texts are too few for one."""
    met = {1: Counter(), 0: Counter()}
    for label, texts in ((1, toxic), (0, ordinary)):
        for t in texts:
            met[label].update(set(words(t)))
    n1, n0 = max(1, len(toxic)), max(1, len(ordinary))
    typical = {w for w, c in met[1].items() if c >= max(LEAST_TEXTS, LEAST_SHARE * n1) and c / n1 > TYPICAL * (met[0][w] + 0.5) / n0}
    own = [b" " + b" ".join(sorted(typical.intersection(words(t)))) + b" " for t in toxic]
    own = [s for s in own if len(s) > 8]
    plain = []
    for t in ordinary:
        w = words(t)
        plain += [b" ".join(w[i : i + 16]) for i in range(0, len(w), 16)]
    if not own or not plain:
        return None

    def dictionary(size: int, samples: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(size, samples, k=SEGMENT, d=6).as_bytes()
        except zstandard.ZstdError:  # too little text: all of it is the dictionary
            return b"".join(dict.fromkeys(samples))[-size:]

    return dictionary(ORDINARY_BYTES, plain), dictionary(TOXIC_BYTES, own)


def _area(values: np.ndarray, labels: np.ndarray) -> float:
    """Area under the ROC curve; ties count half."""
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[at]
    n1, n0 = labels.sum(), (1 - labels).sum()
    return float((ranks[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def _features(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(n)), np.log1p(hits), np.log1p(n)], 1)


def calibrate(gains: Gains, texts: list[str], labels: list[int]) -> tuple[tuple[int, int], tuple[float, float, float]]:
    """The least gain and the greatest rest of a hit, and the weights of the logistic curve."""
    y = np.array(labels)
    each = [np.array([gains[w] for w in words(t)], int).reshape(-1, 2) for t in texts]
    n = np.array([len(e) for e in each])
    hits = {(g, c): np.array([((e[:, 0] >= g) & (e[:, 1] <= c)).sum() for e in each]) for g in GAINS for c in RESTS}
    hit = max(hits, key=lambda h: (round(_area(hits[h], y), 4), h))
    x, w = _features(hits[hit], n), np.zeros(3)
    for _ in range(50):  # Newton's steps, with a little shrinkage of the slopes
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        shrink = np.diag([1e-6, 0.01, 0.01])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (p - y) + shrink @ w)
        w = np.clip(w, -60, 60)
    return hit, tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text. labels: doc_id, label (1 toxic). The sample is the rows of least hash of doc_id of each label."""
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = None
    for label, n in SAMPLE.items():
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = sorted((r.doc_id, r.text, r.label) for r in texts.collect())  # at most SAMPLE rows, a text for each id
    prior = sum(r[2] for r in rows) / len(rows) if rows else 0.0
    split = {(label, part): unlike([t for i, (_, t, y) in enumerate(r for r in rows if r[2] == label) if i % 2 == part]) for label in (0, 1) for part in (0, 1)}
    made = train(split[1, 0], split[0, 0])
    if made is None or not split[1, 1] or not split[0, 1]:
        return Model(b"", b"", (0, 0), (0.0, 0.0, 0.0), prior)
    texts = split[1, 1] + split[0, 1]
    return Model(*made, *calibrate(Gains(*made), texts, [1] * len(split[1, 1]) + [0] * len(split[0, 1])), prior)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, score (0 to 1, higher for toxic), n_hits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hits(model) if model.toxic else None
        a, b, c = model.weights
        for batch in batches:
            scores, found = [], []
            for t in batch.column(0):
                w = words(t.as_py())
                if known is None:
                    scores.append(model.prior), found.append(0)
                    continue
                hits = sum(map(known.__getitem__, w))
                x = a + b * math.log1p(hits) + c * math.log1p(len(w))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x))))), found.append(hits)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64()), pa.array(found, pa.int64())], names=[*keep, "score", "n_hits"])

    rows = docs.select(F.col("text").alias("_text"), *keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType())]))
