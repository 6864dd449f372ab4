"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh, kept, safe_pieces, spread

#: Longest character n-gram, counted with a blank on either side of a word; single characters without.
LONGEST = 5
#: Distinct words whose vectors a worker remembers, and distinct words that it counts before it passes them on.
MEMO, COUNTED = 150_000, 4_000
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Iterator[list[str]]:
    for part in safe_pieces(text, 1 << 18):
        yield _WORDS.findall(part.lower())


def grams_of(word: str, n: int) -> list[str]:
    word = f" {word} " if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def _hashes(grams: list[str]) -> np.ndarray:
    """The 64-bit hash by which the model knows a word or an n-gram; as Spark's xxhash64."""
    return np.fromiter((xxhash.xxh64_intdigest(g.encode(), 42) for g in grams), np.uint64, len(grams))


class WordFirstModel:
    """Log frequencies by language of words (kind 0) and of n-grams (kind n), in order of their hashes.

    ``tables`` has for each kind the sorted hashes and the counts, one column a language. Two of a million n-grams
    share a 64-bit hash with a probability of 3 in 100 million.
    """

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]], langs: list[str]):
        self.langs = langs
        none = (np.zeros(0, np.uint64), np.zeros((0, len(langs))))
        tables = {kind: tables.get(kind, none) for kind in range(LONGEST + 1)}
        self.hashes = {kind: hashes for kind, (hashes, _) in tables.items()}
        self.logs = {kind: np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * max(len(n), 1))).astype(np.float32) for kind, (_, n) in tables.items()}
        self.seen = tables[0][1] > 0

    @classmethod
    def of(cls, counts: dict[int, dict[str, dict[str, int]]], langs: list[str]) -> WordFirstModel:
        """From counts of grams by language for each kind."""
        tables = {}
        for kind, grams in counts.items():
            hashes = _hashes(list(grams))
            table = np.array([[by.get(x, 0) for x in langs] for by in grams.values()], float).reshape(len(grams), len(langs))
            order = np.argsort(hashes)
            tables[kind] = hashes[order], table[order]
        return cls(tables, langs)

    def _find(self, kind: int, grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``grams`` and whether they are there."""
        known, asked = self.hashes[kind], _hashes(grams)
        at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
        return at, known[at] == asked if len(known) else np.zeros(len(asked), bool)

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies of each word by language, and for each language whether it has the word.

        A word in no language backs off to the mean of its longest n-grams that are known; one without any has zeros.
        """
        logs, knows = np.zeros((len(words), len(self.langs))), np.zeros((len(words), len(self.langs)), bool)
        at, there = self._find(0, words)
        logs[there], knows[there] = self.logs[0][at[there]], self.seen[at[there]]
        left = np.flatnonzero(~there)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            grams = [grams_of(words[i], n) for i in left]
            owner = np.repeat(left, [len(x) for x in grams])
            at, there = self._find(n, [g for x in grams for g in x])
            owner, at = owner[there], at[there]
            if len(owner):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                many = np.diff(np.r_[starts, len(owner)])
                logs[owner[starts]] = np.add.reduceat(self.logs[n][at], starts, axis=0) / many[:, None]
                left = np.setdiff1d(left, owner[starts], assume_unique=True)
        return logs, knows

    def vector(self, word: str) -> np.ndarray:
        return self.vectors([word])[0][0]

class Scorer:
    """Predictions by a model; vectors of words are remembered up to a bound."""

    def __init__(self, model: WordFirstModel):
        self.model = model
        self.places: dict[str, int] = {}
        self.table = np.zeros((1024, 2 * len(model.langs)), np.float32)  # logs, then 1 where a language knows the word

    def _learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.places]
        if len(self.places) + len(new) > MEMO:  # a part of a text has fewer words
            self.places.clear()
            new = list(dict.fromkeys(words))
        if not new:
            return
        first = len(self.places)
        while first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(new)] = np.concatenate(self.model.vectors(new), axis=1)
        self.places.update(zip(new, range(first, first + len(new)), strict=True))

    def predict(self, text: str) -> tuple[str, float, float]:
        both, letters, n = np.zeros(self.table.shape[1]), False, 0
        for words in words_of(text):
            letters = letters or any(c.isalpha() for w in words for c in w)
            self._learn(words)
            both += self.table[list(map(self.places.__getitem__, words))].sum(axis=0, dtype=np.float64)
            n += len(words)
        if not letters or not self.model.langs:
            return "und", 0.0, 0.0
        total, known = np.split(both, 2)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum()), float((known[best] + 1) / (n + 1))


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        grams: Counter[tuple[int, str, str]] = Counter()
        for (lang, word), n in seen.items():
            grams[0, word, lang] += n
            for k in range(1, LONGEST + 1):
                for gram in grams_of(word, k):
                    grams[k, gram, lang] += n
        seen.clear()
        kinds, names, langs = zip(*grams, strict=True) if grams else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(names, pa.string()), pa.array(langs, pa.string()), pa.array(list(grams.values()), pa.int64())], ["kind", "gram", "lang", "n"])

    seen: Counter[tuple[str, str]] = kept("langid counts", Counter)
    seen.clear()
    for part in parts:
        for lang, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
            for words in words_of(text.decode("utf-8", "replace")):
                for start in range(0, len(words), COUNTED):
                    seen.update((lang, w) for w in words[start : start + COUNTED])
                    if len(seen) > COUNTED:
                        yield out()
    if seen:
        yield out()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_lang: int = 3000, most_langs: int = 1000) -> WordFirstModel:
    """A model from the rows of ``docs`` that have a text and a language.

    It is fitted on about ``rows_per_lang`` rows of each language at most, fixed by the hash of the text; copies of a
    text in one language count once there. Every word and n-gram of these rows is kept, with its counts in all
    languages: hashes and counts, no texts, come to the driver. Over ``most_langs`` languages are an error (a column
    that names none). Without any row the model knows no language.
    """
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"{lang} has over {most_langs} values")
    langs = sorted(sizes)
    if not langs:
        return WordFirstModel({}, [])
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_lang / n) * (1 << 30))))
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))
    some = some.groupBy("lang", F.xxhash64("text").alias("_h")).agg(F.any_value("text").alias("text")).select("lang", "text")
    counts = some.mapInArrow(_counted, "kind int, gram string, lang string, n long")
    by = counts.groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))
    place = F.create_map(*(F.lit(x) for i, k in enumerate(langs) for x in (k, i)))
    found = by.select(F.col("kind").cast("tinyint").alias("kind"), F.xxhash64("gram").alias("h"), F.element_at(place, F.col("lang")).cast("smallint").alias("lang"), "n").toArrow()
    kind, h, of, n = (found.column(i).to_numpy() for i in range(4))
    tables = {}
    for k in range(LONGEST + 1):
        mine = kind == k
        hashes, at = np.unique(h[mine].view(np.uint64), return_inverse=True)
        table = np.zeros((len(hashes), len(langs)), np.float32)
        np.add.at(table, (at, of[mine]), n[mine])
        tables[k] = hashes, table
    return WordFirstModel(tables, langs)


def identify(docs: DataFrame, model: WordFirstModel, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1, the posterior under equal priors) and known (``names``) of each whole text.

    The score only compares the model's languages; known, the share of words that the predicted one has in the
    model, also tells texts in none of them; one known word more is supposed, as one or two words tell nothing.
    Texts that are null or have no letter get ``und``, 0 and 0, as do all if the model knows no language. Ties go to
    the first language by code point. Equal texts get equal values; an empty table gives an empty table; columns
    named like the new ones are replaced.
    """
    shared, mark = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by the parameters of train()

    def predicted(texts: pa.Array) -> pa.Array:
        predict = kept(mark, lambda: Scorer(shared.value)).predict
        found = [predict(x.decode("utf-8", "replace")) for x in as_bytes(texts)]
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else ((), (), ()), (pa.string(), pa.float64(), pa.float64()), strict=True)], ["l", "s", "k"])

    found = F.arrow_udf(predicted, "l string, s double, k double")(F.col(text))
    (both,) = fresh(docs, "_found")
    return spread(docs).withColumn(both, found).withColumns({name: F.col(both)[x] for name, x in zip(names, "lsk", strict=True)}).drop(both)


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key as text leaves 0 modulo ``folds``; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))
