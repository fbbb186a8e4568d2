"""Language identification: multinomial naive Bayes over hashed n-grams.

``train`` counts hashed character n-grams (1 to 3 letters of lower-cased text,
everything that is no letter being one blank) by label, over all labelled
rows; each task puts out its sums, Spark adds them up, and the log-probability
matrix (buckets x labels, Laplace smoothing, uniform prior) is a few MB at
most: ``BUCKETS`` rows by at most ``MAX_LABELS`` labels.  ``predict``
broadcasts it and scores documents in batches: sparse sums of matrix rows.

Defined results: text that is null or has no letter gets ``und`` and score 0;
so does every text when nothing is labelled; ties go to the first label in
order; long texts are scored in pieces; repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import blocks

BUCKETS = 1 << 16
MAX_LABELS = 1000
MAX_GRAM = 3
UNKNOWN = "und"
FOLDS = 5
_PIECE = 1 << 18
_M = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point: itself lower-cased if it is a letter, else 0."""
    global _letters
    if _letters is None:
        _letters = np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)], np.uint32)
    return _letters


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of ``text``, a piece of it at a time."""
    table = _letter_table()
    for a in range(0, len(text), _PIECE):
        # a piece begins with the end of the one before, so no n-gram is lost
        lead = min(a, MAX_GRAM - 1)
        raw = text[a - lead:a + _PIECE].encode("utf-32-le", "surrogatepass")
        chars = table[np.frombuffer(raw, "<u4")].astype(np.uint64)
        yield _grams(chars, lead)


def _grams(chars: np.ndarray, lead: int) -> np.ndarray:
    out, h = [], np.zeros(len(chars), np.uint64)
    for n in range(1, MAX_GRAM + 1):
        if len(chars) < n:
            break
        h = (h[:len(chars) - n + 1] + chars[n - 1:] + np.uint64(1)) * _M[n - 1]
        h ^= h >> np.uint64(29)
        # n-grams that end in this piece, of which a letter is part
        ends = np.arange(len(h)) + n - 1 >= lead
        some = chars[n - 1:] > 0
        out.append((h[ends & some] >> np.uint64(20)) % np.uint64(BUCKETS))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def rows():
        for label, counts in sums.items():
            k = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([label] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(counts[k])], ["label", "bucket", "n"])
        sums.clear()

    for block in blocks(batches):
        for label, text in zip(block["label"], block["text"]):
            counts = sums.setdefault(label, np.zeros(BUCKETS, np.int64))
            for g in buckets(text):
                counts += np.bincount(g.astype(np.int64), minlength=BUCKETS)
        if len(sums) > 64:
            yield from rows()
    yield from rows()


class Model:
    def __init__(self, labels: list[str], log_p: np.ndarray):
        self.labels, self.log_p = labels, log_p

    def score(self, text: str) -> tuple[str, float]:
        total, seen = np.zeros(len(self.labels)), 0
        for g in buckets(text):
            index, counts = np.unique(g.astype(np.int64), return_counts=True)
            total += counts @ self.log_p[index]
            seen += len(index)
        if not seen or not self.labels:
            return UNKNOWN, 0.0
        p = np.exp(total - total.max())
        k = int(total.argmax())
        return self.labels[k], float(p[k] / p.sum())


def train(docs: DataFrame, label: str = "lang") -> Model:
    """Learns from the rows of ``docs`` with a label."""
    rows = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    # at most MAX_LABELS x BUCKETS rows; checked before they are read
    by_label = counts.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    found = by_label.select("label", F.transform("cells", lambda c: c["bucket"]).alias("bucket"),
                            F.transform("cells", lambda c: c["n"]).alias("n")).limit(MAX_LABELS + 1).toArrow().sort_by("label")
    if found.num_rows > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = found.column("label").to_pylist()
    table = np.ones((BUCKETS, len(labels)))
    for k in range(len(labels)):
        at = found.column("bucket")[k].values.to_numpy(zero_copy_only=False)
        table[at, k] += found.column("n")[k].values.to_numpy(zero_copy_only=False)
    return Model(labels, np.log(table / table.sum(0)).astype(np.float64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (posterior of the predicted label)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for block in blocks(batches):
            found = [own.score(t) for t in block["text"]]
            yield pa.record_batch([pa.array(block["doc_id"], pa.int64()), pa.array([x for x, _ in found], pa.string()),
                                   pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Learns from the folds that are not held out and predicts every row."""
    out = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    model = train(docs.where(~out))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
