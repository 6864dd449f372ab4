"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed words."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, fresh, kept, maybe_broadcast, safe_pieces, spread

#: Buckets of the hashed features, and distinct words whose features a worker remembers.
BUCKETS, MEMO = 1 << 20, 300_000
#: Letters of a word's beginnings.
BEGINNINGS = (3, 4, 5, 6)
_CORE = re.compile(r"^(\W*)(.*?)(\W*)$", re.DOTALL)


#: Check sums of the letters in front of features' names: w, p, m, a, b for words, beginnings, marks alone, after and before.
_W, _P, _M, _A, _B = (zlib.crc32(x) for x in (b"w", b"p", b"m", b"a", b"b"))
_SHOUT = zlib.crc32(b"shout")


def _word_features(word: str) -> tuple[int, ...]:
    """Buckets of a word: itself in lower case, its beginnings, marks around it, and whether it is shouted.

    Beginnings stand in for the word where its other forms are rare.
    """
    before, core, after = ("", word, "") if word.isalnum() else _CORE.match(word).groups()
    low = core.lower()
    raw, n = low.encode(), len(low)
    sums = [zlib.crc32(raw, _W) if low else zlib.crc32(word.encode(), _M)]
    whole = len(raw) == n  # a byte a letter
    sums += [zlib.crc32(raw[:k] if whole else low[:k].encode(), _P) for k in BEGINNINGS if n > k]
    if len(after) > 1:
        sums.append(zlib.crc32(after.encode(), _A))
    if before and low:
        sums.append(zlib.crc32(before.encode(), _B))
    if len(core) > 1 and core == core.upper() != low:
        sums.append(_SHOUT)
    return tuple([x % BUCKETS for x in sums])


class Features:
    """Hashed features of whole texts; words are remembered up to a bound."""

    def __init__(self):
        self.seen: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and their weights: the roots of their shares of the words."""
        counts, words = defaultdict(int), 0
        for part in safe_pieces(text, 1 << 20):
            for word, n in Counter(part.split()).items():
                words += n
                found = self.seen.get(word)
                if found is None:
                    if len(self.seen) >= MEMO:
                        self.seen.clear()
                    found = self.seen[word] = _word_features(word)
                for x in found:
                    counts[x] += n
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        return at, np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)) / max(words, 1))


def features() -> Features:
    """One for each Python worker."""
    return kept("quality", Features)


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = 1 / (1 + exp(score - thresholds[k])): one weight vector for all grades, ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def grade(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        score = float(self.weights[at] @ weight)
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def fit_ordinal(at: np.ndarray, value: np.ndarray, size: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = 200, rate: float = 1.5, decay: float = 1e-5, rare: float = 8.0) -> OrdinalModel:
    """Weights and thresholds by Adam on all rows: ``size`` features each, ``at`` a bucket with a ``value``.

    Thresholds are a first value and positive gaps. Features are scaled by their inverse document frequency and by
    m / (m + ``rare``) of the m rows that have them, so that rare ones count less and none is left out; the weights
    returned include both.
    """
    n, owner = len(size), np.repeat(np.arange(len(size), dtype=np.int32), size)
    times = np.bincount(at, minlength=BUCKETS)
    scale = np.log1p(n / np.maximum(times, 1)) * times / (times + rare)
    value = value * scale[at].astype(np.float32)
    w, t = np.zeros(BUCKETS), np.r_[-1.0, np.zeros(n_grades - 2)]
    state = [np.zeros_like(x) for x in (w, w, t, t)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, rounds + 1 if n else 0):
        edges = np.r_[-np.inf, t[0] + np.r_[0, np.cumsum(np.exp(t[1:]))], np.inf]
        score = np.bincount(owner, w[at] * value, n)
        high, low = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        d_score = (d_high - d_low) / n  # of the negative log likelihood
        d_edges = np.bincount(grades, -d_high, n_grades)[: n_grades - 1] + np.bincount(grades, d_low, n_grades)[1:]
        d_edges /= n
        d_t = np.r_[d_edges.sum(), np.cumsum(d_edges[::-1])[::-1][1:] * np.exp(t[1:])]
        d_w = np.bincount(at, d_score[owner] * value, BUCKETS) + decay * w
        for i, (x, d) in enumerate(((w, d_w), (t, d_t))):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return OrdinalModel((w * scale).astype(np.float32), t[0] + np.r_[0, np.cumsum(np.exp(t[1:]))])


def train(docs: DataFrame, rated: DataFrame, n_grades: int, text: str = "text", key: str = "doc_id", max_rows: int = 8000, max_bytes: int = 1 << 26) -> OrdinalModel:
    """A model from ``rated`` (key, grade 0 .. n_grades - 1), fitted on about ``max_rows`` of its keys at most.

    The sample is fixed by the hash of the key; of it, as many rows as hold about ``max_bytes`` of features (8 bytes
    each) come to the driver, no texts. A key that repeats counts once: the lowest of its grades and, of its texts,
    the one of the smallest hash. Null keys, grades and texts teach nothing; a grade out of range is an error.
    Without any row all texts get the same grade.
    """
    of_id, of_grade = fresh(docs, "_id", "_grade")
    rated = rated.filter(F.col(key).isNotNull() & F.col("grade").isNotNull()).groupBy(F.col(key).alias(of_id)).agg(F.min(F.col("grade").cast("int")).alias(of_grade), F.max(F.col("grade").cast("int")).alias("_top"))
    n, low, high = rated.agg(F.count(F.lit(1)), F.min(of_grade), F.max("_top")).first()
    if n and not 0 <= low <= high < n_grades:
        raise ValueError(f"grades {low} .. {high} are not within 0 .. {n_grades - 1}")
    part = F.pmod(F.xxhash64(of_id), F.lit(1 << 30))
    some = rated.filter(part < int(min(1.0, max_rows / max(n, 1)) * (1 << 30))).select(of_id, of_grade)

    def found(texts: pa.Array) -> pa.Array:
        of = features().of
        each = (of(x.decode("utf-8", "replace")) for x in as_bytes(texts))
        return pa.array((a.astype("<u4").tobytes() + v.astype("<f4").tobytes() for a, v in each), pa.binary(), size=len(texts))

    held = docs.join(maybe_broadcast(some, min(n, 2 * max_rows)), F.col(key) == F.col(of_id)).filter(F.col(text).isNotNull())
    held = held.groupBy(of_id, of_grade).agg(F.min_by(F.col(text), F.xxhash64(F.col(text))).alias("text"))
    held = cut(held.select(F.col(of_id).alias("id"), F.col(of_grade).alias("grade"), F.arrow_udf(found, "binary")("text").alias("x")))
    size = held.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()[0]
    if size > max_bytes:  # the same rows whenever the same documents are rated
        held = held.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(max_bytes / size * (1 << 30)))
    rows = held.filter(F.octet_length("x") > 0).orderBy(F.xxhash64("id"), "id").toArrow()
    raw = [x.as_buffer() for x in rows.column("x")]
    sizes = np.array([x.size // 8 for x in raw], np.int64)
    none = [np.zeros(0, np.int32)]
    at = np.concatenate(none + [np.frombuffer(x, "<u4", k).astype(np.int32) for x, k in zip(raw, sizes, strict=True)])
    value = np.concatenate([np.zeros(0, np.float32)] + [np.frombuffer(x, "<f4", k, 4 * k) for x, k in zip(raw, sizes, strict=True)])
    grades = rows.column("grade").to_numpy().astype(np.int64)
    del rows, raw
    return fit_ordinal(at, value, sizes, grades, n_grades)


def grade(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade and tail_probability (of the highest grade) of each whole text.

    Null, empty and blank texts have no feature: their score is 0, as of a text of unknown words. Equal texts get
    equal values; an empty table gives an empty table; columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def graded(texts: pa.Array) -> pa.Array:
        of, model = features().of, shared.value
        tails = np.array([model.grade(*of(x.decode("utf-8", "replace"))) for x in as_bytes(texts)]).reshape(len(texts), -1)
        return pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["e", "t"])

    found = F.arrow_udf(graded, "e double, t double")(F.col(text))
    (both,) = fresh(docs, "_graded")
    return spread(docs).withColumn(both, found).withColumns({"expected_grade": F.col(both)["e"], "tail_probability": F.col(both)["t"]}).drop(both)


def label_grade(quality: Column, toxic: Column) -> Column:
    """Grades of the ``labels`` table: 0 of low quality, 1 good but toxic, 2 clean."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)
