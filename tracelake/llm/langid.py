"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that is drawn from its code point alone. A letter 3-gram is bound from
its letters' vectors, each rotated by its place in the 3-gram, multiplied element by element; a text bundles (adds) the
vectors of all its 3-grams, and a language's prototype bundles its training texts. A text is compared with every
prototype by cosine. Runs of anything but letters count as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.session import free_names, share_code

DIM = 512
#: 3-grams whose vectors a task keeps, and those that it copies at once; texts that it handles together.
_CACHE_ROWS, _ROWS, _TEXTS = 1 << 15, 1 << 12, 256
_WIDE = 21


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """A number from 1 for every letter in order of code points, 0 for all else; and the code points by number."""
    points = np.flatnonzero(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    number = np.zeros(0x110000, np.int32)
    number[points] = np.arange(1, len(points) + 1)
    return number, np.concatenate(([0], points))


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 3-grams of a whole text, as packed letter numbers, and their counts; nothing if it has no letter."""
    x = _letters()[0][np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    x = np.concatenate((np.zeros(1, np.int32), x, np.zeros(1, np.int32)))
    blank = x == 0
    x = x[1:][~(blank[1:] & blank[:-1])]
    if not x.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.concatenate((np.zeros(1, np.int32), x, np.zeros(int(x[-1] != 0), np.int32)))
    if x.max() < 1 << 10:  # 30 bits sort faster than 63
        packed, counts = np.unique(x[:-2] << 20 | x[1:-1] << 10 | x[2:], return_counts=True)
        packed = packed.astype(np.int64)
        return packed >> 20 << 2 * _WIDE | (packed >> 10 & 1023) << _WIDE | packed & 1023, counts
    x = x.astype(np.int64)
    return np.unique(x[:-2] << 2 * _WIDE | x[1:-1] << _WIDE | x[2:], return_counts=True)


class Encoder:
    """Turns 3-gram counts into bundled vectors; keeps the vectors of a bounded number of 3-grams."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.vectors: dict[int, np.ndarray] = {}
        # kept 3-grams in order, and the rows of bound that hold their vectors
        self.known, self.slots = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bound = np.zeros((_CACHE_ROWS, dim), np.int8)

    def _rows(self, numbers: np.ndarray, turn: int) -> np.ndarray:
        """Letter vectors, rotated by their place; a letter's is drawn from its code point, the blank's from 0."""
        distinct, back = np.unique(numbers, return_inverse=True)
        for k in distinct.tolist():
            if k not in self.vectors:
                self.vectors[k] = np.random.default_rng(int(_letters()[1][k])).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
        return np.roll(np.array([self.vectors[k] for k in distinct.tolist()], np.int8), turn, axis=1)[back]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        low = (1 << _WIDE) - 1
        v = self._rows(grams >> 2 * _WIDE, 2)
        v *= self._rows(grams >> _WIDE & low, 1)
        v *= self._rows(grams & low, 0)
        return v

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the 3-grams' vectors, each by its count, as whole numbers."""
        out, step = np.zeros(self.dim), 1 << 13
        for i in range(0, len(grams), step):
            out += counts[i : i + step].astype(np.float64) @ self.bind(grams[i : i + step])
        return out

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        """bundle of each of a few texts, by way of the kept vectors."""
        every = np.unique(np.concatenate([g for g, _ in texts]))
        fresh = every[~np.isin(every, self.known)]
        if len(every) > _CACHE_ROWS:
            yield from (self.bundle(g, c) for g, c in texts)
            return
        if len(self.known) + len(fresh) > _CACHE_ROWS:
            self.known, self.slots, fresh = self.known[:0], self.slots[:0], every
        if len(fresh):
            first = len(self.known)
            for i in range(0, len(fresh), 1 << 12):
                part = fresh[i : i + (1 << 12)]
                self.bound[first + i : first + i + len(part)] = self.bind(part)
            known = np.concatenate([self.known, fresh])
            order = np.argsort(known)
            self.known, self.slots = known[order], np.concatenate([self.slots, np.arange(first, len(known))])[order]
        for grams, counts in texts:
            slots, out = self.slots[np.searchsorted(self.known, grams)], np.zeros(self.dim)
            # float32 is exact below 2^24
            kind = np.float64 if counts.sum() >= 1 << 24 else np.float32
            counts = counts.astype(kind)
            for i in range(0, len(slots), _ROWS):
                out += counts[i : i + _ROWS] @ self.bound[slots[i : i + _ROWS]].astype(kind)
            yield out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototypes by language over all rows of docs with a non-null language and a letter.

    Tasks bundle what they read into one vector a language; the sums over tasks are taken on the executors, and the
    driver gets dim numbers a language, a partition at a time.
    """
    share_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dim), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i in range(0, len(langs), _TEXTS):
                found: dict[str, list] = {}
                for text, lang in zip(batch.column(0)[i : i + _TEXTS], langs[i : i + _TEXTS], strict=True):
                    found.setdefault(lang, []).append(ngrams(text.as_py()))
                for lang, texts in found.items():
                    grams, at = np.unique(np.concatenate([g for g, _ in texts]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([c for _, c in texts]), len(grams))
                    if len(grams):
                        sums[lang] = sums.get(lang, 0) + next(encoder.bundles([(grams, counts)])).astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(v, pa.float64())], names=["lang", "d", "x"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    # whole numbers below 2^53: the sums don't depend on the order of the tasks
    sums = rows.mapInArrow(run, "lang string, d int, x double").groupBy("lang", "d").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        out.setdefault(r["lang"], np.zeros(dim))[r["d"]] = r["x"]
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(out.items())}


def identify(prototypes: dict[str, np.ndarray], dim: int = DIM) -> Column:
    """A function of a text column: struct(lang, score). und with score 0: null text, no letter, or nothing learned.

    It counts as not deterministic, else Spark runs it twice, in two Python workers a task, where a filter reads it too.
    """
    langs = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in langs], np.float32).reshape(len(langs), dim)
    state: list[Encoder] = []

    def run(texts: pa.Array) -> pa.Array:
        if not state:
            state.append(Encoder(dim))
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        for first in range(0, len(texts), _TEXTS):
            found = [(i, ngrams(texts[i].as_py())) for i in range(first, min(len(texts), first + _TEXTS))]
            found = [(i, x) for i, x in found if len(x[0]) and langs]
            if not found:
                continue
            for (i, _), v in zip(found, state[0].bundles([x for _, x in found]), strict=True):
                cos = matrix @ v.astype(np.float32) / max(float(np.linalg.norm(v)), 1e-12)
                best = int(cos.argmax())
                names[i], scores[i] = langs[best], float(min(1.0, max(0.0, cos[best])))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "lang string, score double").asNondeterministic()


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of training: crc32 of its id as text, mod 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of docs, predicted from its whole text alone.

    Prototypes are learned from the rows that are not held out and have an id, a language and a letter. Ties go to the
    language that sorts first. Repeated rows each come back and each count in training; an empty table gives an empty
    result; if nothing was learned, every text is und. Other columns are not read.
    """
    prototypes = train(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), text_col, lang_col, dim)
    named = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), identify(prototypes, dim)(F.col(text_col)).alias("_p"))
    return named.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.1, dim: int = DIM) -> DataFrame:
    """The rows of docs whose language is told with at least min_score, with docs' own columns and lang as it was told.

    Null texts and texts without a letter are not told and go; so do all texts if nothing was learned. Null languages
    and ids are no bar. Repeated rows are told alike; an empty table gives an empty result; columns may have any names.
    """
    prototypes = train(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), text_col, lang_col, dim)
    (name,) = free_names(docs, 1)
    told = docs.withColumn(name, identify(prototypes, dim)(F.col(text_col))).where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= min_score))
    return told.select(*[F.col(f"{name}.lang").cast(docs.schema[c].dataType).alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
