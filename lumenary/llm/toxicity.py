"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each is a logistic regression on which words a
text has (hashed), and on the log-odds of every category before it. In training those come from
models that have not seen the row (out-of-fold), so a later model learns how far an earlier one
can be trusted on new texts.

The chain is fitted on at most ``most_rows`` labelled rows, those of least hash of their id, which
bounds what the driver gathers; it then scores every row of the corpus.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.llm import hashing
from lumenary.llm.common import release, text_batches

#: Words are hashed to this many bits.
BITS = 18
#: Probability from which a text is of a category. Most words of an unseen insult are unknown, so
#: what is half as likely as not is taken, too; on labelled rows that costs a thousandth of the others.
LEAST = 0.35

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of each text, each once and rising, in a row; and where each text's end."""
    data, ends = hashing.join([text.lower().encode("utf-8", "surrogatepass") for text in texts])
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    starts, stops, text = hashing.words(data, ends, _LETTER)
    hashed = hashing.Rolling(data).spans(starts, stops) >> np.uint64(64 - BITS)
    own = np.unique(text << BITS | hashed.astype(np.int64))
    return own & ((1 << BITS) - 1), np.searchsorted(own >> BITS, np.arange(len(texts)), side="right")


@dataclass
class Rows:
    """Sparse 0/1 rows: the columns of row r are ``columns[ends[r-1]:ends[r]]``."""

    columns: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ends)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends, prepend=0))

    def take(self, keep: np.ndarray) -> Rows:
        on = keep[self.row]
        return Rows(self.columns[on], np.cumsum(np.diff(self.ends, prepend=0)[keep]))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.columns], len(self))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def telling(rows: Rows, y: np.ndarray, least_rows: int) -> np.ndarray:
    """Which columns depend on ``y``: G-test statistic over 2 log(number of columns in use)."""
    size, n, positive = 1 << BITS, len(rows), y.sum()
    total = np.bincount(rows.columns, minlength=size).astype(float)
    with_y = np.bincount(rows.columns, y[rows.row], size)

    def term(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300))

    share = positive / max(n, 1)
    cells = term(with_y, total * share) + term(total - with_y, total * (1 - share))
    cells += term(positive - with_y, (n - total) * share) + term(n - positive - total + with_y, (n - total) * (1 - share))
    return (total >= least_rows) & (2 * cells >= 2 * np.log(max((total > 0).sum(), 2)))


@dataclass
class Linear:
    """Logistic regression on sparse 0/1 columns and a few dense ones."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: Rows, more: np.ndarray, y: np.ndarray, *, least_rows: int, penalty: float, steps: int) -> Linear:
        """Full-batch Adam steps on the mean loss.

        Only columns that ``least_rows`` rows have and that tell the classes apart are used: those
        whose likelihood-ratio statistic is beyond what the best of as many random ones reaches.
        """
        size = 1 << BITS
        often = telling(rows, y, least_rows)
        names = np.flatnonzero(often)
        place = np.zeros(size, np.int64)
        place[names] = np.arange(len(names))
        on = often[rows.columns]
        column, row = place[rows.columns[on]], rows.row[on]
        n, k, m = len(rows), len(names), more.shape[1]
        w = np.zeros(k + m + 1)
        share = float(np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3))
        w[-1] = np.log(share / (1 - share))
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1 if n else 1):
            z = np.bincount(row, w[column], n) + more @ w[k : k + m] + w[-1]
            r = (_sigmoid(z) - y) / n
            grad = np.concatenate((np.bincount(column, r[row], k), r @ more, [r.sum()])) + penalty * w
            grad[-1] -= penalty * w[-1]
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad * grad
            rate = 0.2 * (1 - step / (steps + 1))
            w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights = np.zeros(size)
        weights[names] = w[:k]
        return cls(weights, w[k : k + m], float(w[-1]))

    def odds(self, rows: Rows, more: np.ndarray) -> np.ndarray:
        return rows.times(self.weights) + more @ self.dense + self.bias


@dataclass
class Chain:
    """Linear models of ``categories``, each fed with the log-odds of those before it."""

    categories: Sequence[str]
    models: list[Linear] = field(default_factory=list)

    @classmethod
    def fit(
        cls, categories: Sequence[str], rows: Rows, labels: np.ndarray, *, folds: int = 3,
        least_rows: int = 5, penalty: float = 1e-4, steps: int = 80,
    ) -> Chain:
        """``labels``: a row of 0 and 1 for each of ``rows``, a column for each category."""
        chain, n = cls(categories), len(rows)
        own = {"least_rows": least_rows, "penalty": penalty, "steps": steps}
        more = np.zeros((n, 0))
        fold = np.arange(n) % folds
        for k in range(len(categories)):
            y = labels[:, k].astype(float)
            chain.models.append(Linear.fit(rows, more, y, **own))
            if k + 1 == len(categories):
                break
            unseen = np.zeros(n)
            for f in range(folds):
                inside = fold != f
                model = Linear.fit(rows.take(inside), more[inside], y[inside], **own)
                unseen[~inside] = model.odds(rows.take(~inside), more[~inside])
            more = np.column_stack((more, np.clip(unseen, -10, 10)))
        return chain

    def probabilities(self, rows: Rows) -> np.ndarray:
        """A column for each category."""
        more = np.zeros((len(rows), 0))
        for model in self.models:
            more = np.column_stack((more, np.clip(model.odds(rows, more), -10, 10)))
        return _sigmoid(more)


def train(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, most_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", **options
) -> Chain:
    """A chain from labelled documents; ``labels``: ``doc_id`` and a 0/1 column for each category.

    Rows with a null label or id are not used, nor is a label whose document is missing. Of labels
    that repeat an id one is taken, and of documents that share a labelled id the one whose words
    come first. Without any usable row the chain calls every text clean.
    """
    sample = (
        labels.select(F.col("doc_id"), *[F.col(c).cast("double").alias(c) for c in categories])
        .dropna()
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    # most_rows rows at most, so a broadcast
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text", 1 << 18):
            columns, ends = features(texts)
            cut = [c.astype("<u4").tobytes() for c in np.split(columns, ends[:-1])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *part.columns[2:], pa.array(cut, pa.binary())], names=["doc_id", *categories, "words"]
            )

    fields = [T.StructField(c, T.DoubleType()) for c in categories]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *fields, T.StructField("words", T.BinaryType())])
    # of documents that share an id one, so most_rows rows at most come to the driver
    once = held.select("doc_id", "text", *categories).mapInArrow(run, schema).groupBy("doc_id", *categories).agg(F.min("words").alias("words"))
    got = sorted(once.collect())
    words = [np.frombuffer(row[-1], "<u4").astype(np.int64) for row in got]
    rows = Rows(np.concatenate([np.zeros(0, np.int64), *words]), np.cumsum([len(w) for w in words], dtype=np.int64))
    truth = np.array([row[1:-1] for row in got]).reshape(len(got), len(categories))
    chain = Chain.fit(categories, rows, truth, **options)
    del got, words, rows, truth
    gc.collect()
    release(keep=True)  # the driver has other work to do
    return chain


def score(docs: DataFrame, chain: Chain, keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the columns ``keep`` and ``p_<category>`` of every row.

    A null or empty text has no words and gets the odds of that; repeated rows have equal
    probabilities; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)  # 2**BITS numbers for each category
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *(docs.schema[c] for c in keep)]
    schema = T.StructType(fields + [T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, len(schema) - len(chain.categories), 1 << 18):
            p = held.value.probabilities(Rows(*features(texts)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=schema.names
            )

    return docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def screen(docs: DataFrame, chain: Chain, category: str, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose probability of ``category`` is below ``least``, as they were.

    A row at ``least`` exactly goes. A null or empty text is judged as one without words; repeated
    rows go or stay together; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)
    place = list(chain.categories).index(category)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, text_col, 1 << 18):
            p = held.value.probabilities(Rows(*features(texts)))[:, place]
            yield part.filter(pa.array(p < least))

    return docs.mapInArrow(run, docs.schema)
