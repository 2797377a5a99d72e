"""Quality scores by a regularised quadratic discriminant.

Statistics of a whole text (lengths, and shares of character classes) are
transformed to tame their tails; each class has a mean and a covariance shrunk
towards a scaled identity.  A score is the logistic of the difference of the
two Mahalanobis log-densities, which need only the inverse Cholesky factors
cached in the model.  Fitting takes sums over all labelled rows in one
aggregation; nothing but class moments reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import blocks, byte_buffers, passing_tables, text_rows, written
from voxloom.llm.hashing import word_hashes

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "stop", "mark", "symbol", "bang", "bar", "wide", "line", "repeated", "again",
)
SHRINKAGE = 0.1
#: Added to a text's size where a share is taken: short texts have noisy shares.
SMOOTH_BYTES, SMOOTH_WORDS = 128, 20
BLOCK = 1 << 20


def _class(chars: bytes) -> np.ndarray:
    found = np.zeros(256, np.uint8)
    found[list(chars)] = 1
    return found


UPPER = _class(bytes(range(65, 91)))
DIGIT = _class(b"0123456789")
STOP = _class(b".,;:?")
MARK = _class(b"'\"()-_/@")
BANG = _class(b"!")
BAR = _class(b"|")
BLANK = _class(b" \t\n\r\v\f")
WIDE = _class(bytes(range(128, 256)))
SYMBOL = _class(b"#$%&*+<=>[\\]^`{}~")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of each text, one row each, from UTF-8 bytes."""
    starts, ends = offsets[:-1], offsets[1:]
    n = (ends - starts).astype(np.float64)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[ends] - sums[starts]).astype(np.float64)

    first = np.zeros(len(data) + 1, np.uint8)
    first[starts] = 1
    hashes, per_text = word_hashes(data, offsets)
    words = per_text.astype(np.float64)
    twice = np.zeros(len(hashes), np.int64)
    twice[1:] = hashes[1:] == hashes[:-1]
    cuts = np.concatenate([[0], np.cumsum(per_text)])
    twice[cuts[:-1][per_text > 0]] = 0
    runs = np.concatenate([[0], np.cumsum(twice)])
    again = np.sqrt((runs[cuts[1:]] - runs[cuts[:-1]]) / (words + SMOOTH_WORDS))
    symbol = SYMBOL[data]
    same = np.zeros(len(data), np.uint8)
    if len(data):
        same[1:] = (data[1:] == data[:-1]) & ((symbol | BANG[data] | STOP[data])[1:] == 1) & (first[1:-1] == 0)
    size = n + SMOOTH_BYTES
    share = lambda mask: np.sqrt(count(mask) / size)
    columns = [
        np.log1p(n), np.log1p(words), np.log1p((n - count(BLANK[data])) / (words + 1)),
        share(UPPER[data]), share(DIGIT[data]), share(STOP[data]), share(MARK[data]), share(symbol), share(BANG[data]),
        share(BAR[data]), share(WIDE[data]), share((data == 10).view(np.uint8)), share(same), again,
    ]
    return np.stack(columns, 1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the transformed statistics of each whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK):
            x = statistics(*byte_buffers(block.column(1)))
            flat = pa.array(np.ascontiguousarray(x).ravel())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_pydict({"doc_id": block.column(0), "x": pa.ListArray.from_arrays(ends, flat)})

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and log priors."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The logistic of the log-density difference per dimension."""
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(self.log_priors[k] - 0.5 * (self.log_dets[k] + (z**2).sum(1)))
        logit = np.clip((density[1] - density[0]) / x.shape[1], -30, 30)
        return 1 / (1 + np.exp(-logit))


def fit(labelled: DataFrame, dims: int, shrinkage: float = SHRINKAGE) -> Discriminant | None:
    """A discriminant of rows (x, label 0 or 1); None where a class lacks rows.

    Each partition adds up its own moments; what is collected is 2 classes of
    1 + dims + dims^2 sums, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + dims + dims * dims))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        n = sums.shape[1]
        yield pa.RecordBatch.from_pydict(
            {"label": pa.array(np.repeat([0, 1], n), pa.int32()), "at": pa.array(np.tile(np.arange(n), 2), pa.int32()), "value": pa.array(sums.ravel())}
        )

    moments = labelled.select("x", "label").mapInArrow(run, "label int, at int, value double")
    total = np.zeros((2, 1 + dims + dims * dims))
    for row in moments.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        total[row["label"], row["at"]] = row["value"]
    counts = total[:, 0]
    if (counts < 2).any():
        return None
    means = total[:, 1 : 1 + dims] / counts[:, None]
    factors, log_dets = [], []
    pooled = sum(total[k, 1 + dims :].reshape(dims, dims) - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)) / counts.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    for k in (0, 1):
        own = total[k, 1 + dims :].reshape(dims, dims) / counts[k] - np.outer(means[k], means[k])
        own = own / np.outer(scale, scale)
        shrunk = (1 - shrinkage) * own + shrinkage * max(np.trace(own) / dims, 1e-3) * np.eye(dims)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower) / scale)
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(log_dets), np.log(counts / counts.sum()))


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether an id's labels are kept from fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit_labels(known: DataFrame, labels: DataFrame, id_col: str, label_col: str, shrinkage: float) -> Discriminant | None:
    """A discriminant from the labels that are not held out."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return fit(known.join(marks, "doc_id"), len(STATISTICS), shrinkage)


def keep_quality(
    docs: DataFrame, labels: DataFrame, reject_below: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = SHRINKAGE
) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``reject_below`` or more.

    Only statistics are joined with labels; texts are scored where they are
    read and never shuffled.  Edge cases are those of ``quality_scores``; with
    nothing learned every row stays.
    """
    with passing_tables(docs.sparkSession):
        known = written(document_statistics(docs, id_col, text_col), "statistics")
        model = fit_labels(known, labels, id_col, label_col, shrinkage)
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col, BLOCK):
            score = model.score(statistics(*byte_buffers(block.column(at))))
            yield block.filter(pa.array(score >= reject_below))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = SHRINKAGE
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of each row.

    Labels are learned from ids that are not held out; ids, labels and any
    other columns are no inputs of a score.  Null and empty texts get the score
    of an empty text.  Where a class has fewer than two labelled rows there is
    nothing to tell apart: scores are 0.5.  Null labels are passed over,
    repeated rows count each, an empty table gives no rows.
    """
    dims = len(STATISTICS)
    known = written(document_statistics(docs, id_col, text_col), "statistics")
    model = fit_labels(known, labels, id_col, label_col, shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            score = model.score(flat) if model else np.full(len(flat), 0.5)
            predicted = pa.array((score >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    rows = known.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
