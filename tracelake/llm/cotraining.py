"""Quality classifier by co-training.

Two views of a document are classified apart, with nothing in common: what it says (words and word endings of its whole
text, and the form of that text: repeats, symbols, capitals, lines) and its page metadata (source, language, recorded
length, and their crosses). Both are naive Bayes models over binary features, which train by counting, so a training
pass is one scan with partial sums. In every round each view labels the unlabelled documents it is sure of for the
other view. Labelled documents are dealt over three parts: most train, some calibrate each view's score (isotonic
regression over score bins), and the rest, held out, do neither. The calibrated views are combined to score all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.session import cut, share_code

#: Features of the text view (words, then form) and of the metadata view, as powers of two.
WORD_BITS, FORM_BITS, META_BITS = 13, 9, 10
#: Blocks of features by view: a score is the sum of the mean log odds of each block.
BLOCKS = (((0, 1 << WORD_BITS), (1 << WORD_BITS, (1 << WORD_BITS) + (1 << FORM_BITS))), ((0, 1 << META_BITS),))
WIDTHS = tuple(b[-1][1] for b in BLOCKS)
ROUNDS, CONFIDENT, PSEUDO_WEIGHT = 2, 0.95, 0.5
NO_PART, TRAIN, CALIBRATE, TEST = range(4)
_BINS, _REACH, _ROWS = 200, 4.0, 256
_SYMBOLS = str.maketrans("", "", "#*$%&|<>!")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def text_features(text: str | None) -> np.ndarray:
    """Numbers of the features of a whole text: its distinct lower-cased words and their last three bytes, and its form."""
    text = text or ""
    every = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    words = set(every)
    ends = {w[-3:] + b"\0" for w in words}
    said = np.fromiter((zlib.crc32(x) & ((1 << WORD_BITS) - 1) for x in (*words, *ends)), np.int64, len(words) + len(ends))
    rows = text.split("\n")
    lines, n = len(rows), max(1, len(every))
    symbols = len(text) - len(text.translate(_SYMBOLS))
    shouted = sum(map(str.isupper, text.split()))
    form = (
        f"words={len(every).bit_length()}", f"lines={lines.bit_length()}", f"width={(len(text) // lines).bit_length()}", f"repeated lines={min(10, 10 * (lines - len(set(rows))) // lines)}",
        f"distinct words={10 * len(words) // n} of {n.bit_length()}", f"symbols={min(10, 40 * symbols // n)}", f"shouted={10 * shouted // n}",
    )
    shape = np.array([zlib.crc32(x.encode()) & ((1 << FORM_BITS) - 1) for x in form], np.int64)
    return np.concatenate((said, shape + (1 << WORD_BITS)))


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Numbers of the features of a document's metadata; what is null is a value of its own."""
    size = "none" if n_chars is None else int(4 * np.log2(max(n_chars, 0) + 1))
    told = (f"lang={lang}", f"source={source}", f"size={size}", f"lang={lang} size={size}", f"source={source} lang={lang}")
    return np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << META_BITS) - 1) for x in told], np.int64)


def _packed(numbers: np.ndarray, width: int) -> bytes:
    there = np.zeros(width, np.uint8)
    there[numbers] = 1
    return zlib.compress(np.packbits(there).tobytes(), 1)


def _dense(packed: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.array([np.frombuffer(zlib.decompress(x), np.uint8) for x in packed]), axis=1).astype(np.float32)


def features(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, label, part, text, meta): packed features of every row of docs with its label, cut to a written table.

    label: 1 or 0, null where unlabelled; an id with several labels takes their rounded mean. part, by crc32 of the id:
    of five shares of the labelled, one calibrates (CALIBRATE), one is held out (TEST), and the others train (TRAIN).
    """
    share_code(docs.sparkSession)
    told = {c: F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"), *[c.alias(f"_{k}") for k, c in told.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = [], []
            for t, *rest in zip(batch.column(1), *[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                t = t.as_py()
                text.append(_packed(text_features(t), WIDTHS[0]))
                meta.append(_packed(meta_features(*rest), WIDTHS[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], names=["id", "text", "meta"])

    made = rows.mapInArrow(run, "id long, text binary, meta binary")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    share = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    part = F.when(F.col("label").isNull(), NO_PART).when(share == 0, CALIBRATE).when(share == 1, TEST).otherwise(TRAIN)
    return cut(made.join(known, "id", "left").select("id", "label", part.alias("part"), "text", "meta"))


class View:
    """Naive Bayes over one view with a calibrated score. counts: documents of each class by feature; last the class size."""

    def __init__(self, counts: np.ndarray, blocks: tuple[tuple[int, int], ...]):
        self.blocks = blocks
        size = counts[:, -1:]
        self.size = counts[:, -1].copy()
        chance = (counts[:, :-1] + 0.5) / (size + 1.0)
        self.weight = (np.log(chance[1]) - np.log(chance[0])).astype(np.float32)
        self.edges, self.value = np.zeros(0), np.full(1, (size[1, 0] + 1) / (size.sum() + 2))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean log odds of a document's features, summed over blocks: long texts are no surer than short ones."""
        total = np.zeros(len(x))
        for lo, hi in self.blocks:
            total += x[:, lo:hi] @ self.weight[lo:hi] / np.maximum(x[:, lo:hi].sum(1), 1)
        return np.clip(total, -_REACH, _REACH)

    def calibrate(self, hist: np.ndarray) -> None:
        """Isotonic regression of labels on score bins; hist: labelled documents by class and bin."""
        blocks: list[list[float]] = []
        for i in np.flatnonzero(hist.sum(0)):
            blocks.append([hist[1, i], hist[:, i].sum(), float(i)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                good, whole, _ = blocks.pop()
                blocks[-1][0] += good
                blocks[-1][1] += whole
        if blocks:
            self.edges = np.array([b[2] for b in blocks[1:]])
            self.value = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])

    def chance(self, score: np.ndarray) -> np.ndarray:
        return self.value[np.searchsorted(self.edges, bins(score), side="right")]


def bins(score: np.ndarray) -> np.ndarray:
    return np.minimum(((score + _REACH) / (2 * _REACH) * _BINS).astype(np.int64), _BINS - 1)


def _summed(rows: DataFrame, run, width: int) -> np.ndarray:
    """Sums, over all tasks, of the (2, width) arrays that run yields: at most 2 * width numbers reach the driver."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for part in run(batches):
            total += part
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.float64())], names=["at", "x"])

    out = np.zeros(2 * width)
    for r in rows.mapInArrow(flat, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out.reshape(2, width)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Labels (-1: none), parts and dense features of a few rows at a time."""
    for i in range(0, len(batch), _ROWS):
        part = batch.slice(i, _ROWS)
        label = np.array([-1 if x is None else x for x in part.column("label").to_pylist()])
        yield label, part.column("part").to_numpy(), _dense(part.column("text").to_pylist()), _dense(part.column("meta").to_pylist())


def _train(rows: DataFrame, views: tuple[View, View] | None, confident: float, pseudo_weight: float) -> tuple[View, View]:
    """Both views counted anew: labelled documents count for both, surely scored unlabelled ones for the other view."""
    sizes = (WIDTHS[0] + 1, WIDTHS[1] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for label, share, *x in _pieces(batch):
                total = np.zeros((2, sum(sizes)))
                for k in (0, 1):
                    part = total[:, : sizes[0]] if k == 0 else total[:, sizes[0] :]
                    weight = np.array([(label == c) & (share == TRAIN) for c in (0, 1)], np.float32)
                    if views is not None:
                        p = views[1 - k].chance(views[1 - k].score(x[1 - k]))
                        weight += pseudo_weight * np.array([(label < 0) & (p <= 1 - confident), (label < 0) & (p >= confident)], np.float32)
                    part[:, :-1] = weight @ x[k]
                    part[:, -1] = weight.sum(1)
                yield total

    used = rows if views is not None else rows.where(F.col("part") == TRAIN)
    total = _summed(used, run, sum(sizes))
    return View(total[:, : sizes[0]], BLOCKS[0]), View(total[:, sizes[0] :], BLOCKS[1])


def _calibrate(rows: DataFrame, views: tuple[View, View]) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for label, _, *x in _pieces(batch):
                total = np.zeros((2, 2 * _BINS))
                for k in (0, 1):
                    np.add.at(total, (label, bins(views[k].score(x[k])) + k * _BINS), 1)
                yield total

    hist = _summed(rows.where(F.col("part") == CALIBRATE), run, 2 * _BINS)
    for k in (0, 1):
        views[k].calibrate(hist[:, k * _BINS : (k + 1) * _BINS])


def co_train(rows: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, pseudo_weight: float = PSEUDO_WEIGHT) -> tuple[tuple[View, View], list[tuple[int, str, int, int]]]:
    """The calibrated views after so many rounds over features, and what was exchanged: (round, view, bad, good), the documents that the other view has labelled for a view."""
    views = _train(rows, None, confident, pseudo_weight)
    _calibrate(rows, views)
    labelled, told = views[0].size, []
    for r in range(rounds):
        views = _train(rows, views, confident, pseudo_weight)
        _calibrate(rows, views)
        given = [np.rint((v.size - labelled) / pseudo_weight).astype(int).tolist() for v in views]
        told += [(r + 1, name, *n) for name, n in zip(("text", "meta"), given, strict=True)]
    return views, told


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rounds: int = ROUNDS, confident: float = CONFIDENT, pseudo_weight: float = PSEUDO_WEIGHT, keep_at: float = 0.5) -> DataFrame:
    """(doc_id, held_out, p_text, p_meta, score, kept): one row per row of docs.

    held_out: labelled, but neither trained nor calibrated on. score: the combined chance of good quality; kept: score
    >= keep_at. Ids are whole numbers. A null text has no text features and is scored
    by its metadata; null metadata is a value of its own; labels without a document, or null, are not used. Without
    labels every score is 0.5. Repeated rows each come back and each count. Extra columns are not read.
    """
    rows = features(docs, labels, id_col, text_col, label_col)
    views, _ = co_train(rows, rounds, confident, pseudo_weight)
    base = rows.where(F.col("part") == TRAIN).agg(F.avg("label")).first()[0]
    prior = min(max(0.5 if base is None else base, 1e-3), 1 - 1e-3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)] * 2
            for _, _, *x in _pieces(batch):
                out = [np.concatenate([o, v.chance(v.score(y))]) for o, v, y in zip(out, views, x, strict=True)]
            odds = sum(np.log(p) - np.log1p(-p) for p in (np.clip(o, 1e-4, 1 - 1e-4) for o in out)) - (np.log(prior) - np.log1p(-prior))
            score = 1 / (1 + np.exp(-odds))
            cols = [batch.column(0), pa.array(batch.column(2).to_numpy() == TEST, pa.bool_()), *[pa.array(o, pa.float64()) for o in out], pa.array(score, pa.float64()), pa.array(score >= keep_at, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "p_text", "p_meta", "score", "kept"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, p_text double, p_meta double, score double, kept boolean")
