"""Quality classifier: random-indexing word vectors and a two-layer network.

Tokens are maximal runs of one byte class (letters, digits, marks), hashed into
``BUCKETS`` rows.  Random indexing: each bucket has a fixed sparse vector of a
few +1 and -1, drawn from its number; a bucket's word vector is the sum of the
sparse vectors of the tokens next to its occurrences, over all documents.  Every
task sums its own part as integers and Spark adds the parts, so the result does
not depend on the order.  The table has a fixed size (``BUCKETS`` x ``DIM``) and
is broadcast.

A document is the mean of its tokens' normalised word vectors, and of the sparse
vectors themselves, with a few ratios of byte classes.  The network is fitted on
at most ``FIT_ROWS`` labelled documents (those of least hash, a documented
bound), its probabilities are calibrated by one temperature on a part of them
that is not fitted.  Scores cover all documents.

Defined results: a null or empty text has a vector of zeros and the score that
gives; repeated rows are scored alike; without labels of both classes every
score is the share of label 1 (0.5 without any); an empty table gives an empty
table; further columns are ignored and never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, flat, id_text, slices, stash

BUCKETS = 8192
DIM = 32
#: Non-zero entries of a sparse index vector.
NONZERO = 4
#: Neighbours on each side that a token's vector sums.
REACH = 2
#: Labelled documents that the network is fitted and calibrated on, at most.
FIT_ROWS = 20_000
HIDDEN = 24

_CLASS = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 mark
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

_hash = SpanHash(0x5851F42D4C957F2D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token, and the rows' bounds among the tokens."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    cut = np.empty(n + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[0] = cut[-1] = True
    cut[offsets] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    solid = kind[starts] != 0
    starts, ends = starts[solid], ends[solid]
    return (_hash(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors(seed: int = 7) -> np.ndarray:
    """(BUCKETS, DIM) fixed sparse vectors of +1 and -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.int64)
    where = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, where, rng.choice([-1, 1], where.shape), axis=1)
    return out


_INDEX = index_vectors()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BUCKETS, DIM), np.int64)
    where = np.argsort(-np.abs(_INDEX), axis=1, kind="stable")[:, :NONZERO]
    signs = np.take_along_axis(_INDEX, where, axis=1).astype(np.float64)
    for batch in slices(batches):
        bucket, bounds = tokens(*flat(batch.column("text")))
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for step in range(1, REACH + 1):
            same = row[step:] == row[:-step]
            left, right = bucket[:-step][same], bucket[step:][same]
            for a, b in ((left, right), (right, left)):
                for k in range(NONZERO):
                    total += np.bincount(a * DIM + where[b, k], weights=signs[b, k], minlength=BUCKETS * DIM).astype(np.int64).reshape(BUCKETS, DIM)
    some = np.flatnonzero(total.any(axis=1))
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(total[some, d]) for d in range(DIM))], names=["bucket", *(f"c{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) word vectors of unit length, summed over all documents."""
    names = [f"c{d}" for d in range(DIM)]
    parts = id_text(docs).select("text").mapInArrow(_contexts, "bucket int, " + ", ".join(f"{n} long" for n in names))
    table = parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIM))
    if len(table):
        out[table["bucket"].to_numpy()] = table[names].to_numpy()
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


WIDTH = 2 * DIM + 7


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(rows, WIDTH) document vectors."""
    bucket, bounds = tokens(data, offsets)
    rows = len(offsets) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    counts = np.diff(bounds)
    some = np.flatnonzero(counts)
    if len(some):
        table = np.hstack([vectors, _INDEX.astype(np.float32)])
        out[some, : 2 * DIM] = np.add.reduceat(table[bucket], bounds[some], axis=0) / counts[some, None]
        row = np.repeat(np.arange(rows), counts)
        for j, step in enumerate((1, 2)):  # how many tokens repeat the one before, or the one before that
            again = np.zeros(len(bucket), np.int64)
            again[step:] = (bucket[step:] == bucket[:-step]) & (row[step:] == row[:-step])
            out[some, 2 * DIM + 5 + j] = np.add.reduceat(again, bounds[some]) / counts[some]
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        lengths = np.diff(offsets)[full].astype(np.float32)
        kind = _CLASS[data]
        flags = [kind == 0, kind == 2, kind == 3, _UPPER[data]]
        for j, flag in enumerate(flags):
            out[full, 2 * DIM + j] = np.add.reduceat(flag.astype(np.int64), offsets[full]) / lengths
        out[full, 2 * DIM + 4] = np.log1p(lengths) / 10
    return out


def document_vectors(docs: DataFrame, vectors: np.ndarray, with_digest: bool = False) -> DataFrame:
    """doc_id and vec, the document's vector as little-endian 32-bit floats; ``with_digest`` adds text_sha256."""
    more = ["text_sha256"] if with_digest else []
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vecs = pooled(*flat(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([v.tobytes() for v in vecs], pa.binary()), *map(batch.column, more)], names=["doc_id", "vec", *more])

    texts = id_text(docs)
    if not with_digest:
        return texts.mapInArrow(run, "doc_id long, vec binary")
    return texts.withColumn("text_sha256", F.sha2("text", 256)).mapInArrow(run, "doc_id long, vec binary, text_sha256 string")


class Network:
    """Two layers with tanh between, fitted by Adam on weighted log loss, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1, epochs: int = 60, batch: int = 256) -> None:
        rng = np.random.default_rng(seed)
        self.constant = None
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        order = rng.permutation(len(y))
        held, fit = order[: len(y) // 5], order[len(y) // 5 :]
        if len(np.unique(y[fit])) < 2:
            held, fit = order, order
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-4
        z = (x - self.mean) / self.scale
        weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            fit = rng.permutation(fit)
            for lo in range(0, len(fit), batch):
                rows = fit[lo : lo + batch]
                hidden = np.tanh(z[rows] @ weights[0] + weights[1])
                error = (_sigmoid(hidden @ weights[2] + weights[3]) - y[rows]) / len(rows)
                back = np.outer(error, weights[2]) * (1 - hidden**2)
                slopes = [z[rows].T @ back + 1e-4 * weights[0], back.sum(axis=0), hidden.T @ error + 1e-4 * weights[2], error.sum()]
                step += 1
                for i, g in enumerate(slopes):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    weights[i] = weights[i] - 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = weights, 1.0
        if len(held):
            logits = self.logits(x[held])
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            p = [np.clip(_sigmoid(logits / t), 1e-9, 1 - 1e-9) for t in grid]
            self.temperature = float(grid[np.argmin([-(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)).mean() for q in p])])

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.weights[0] + self.weights[1])
        return hidden @ self.weights[2] + self.weights[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def held_out(doc_id):
    """Rows never learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(vecs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Network:
    """A network fitted on at most ``rows`` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    table = vecs.select("doc_id", "vec").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "vec").limit(rows)  # rows of one doc_id count each
    table = table.toPandas().sort_values(["doc_id", "y", "vec"])
    x = np.frombuffer(b"".join(table["vec"].tolist()), "<f4").reshape(-1, WIDTH).astype(np.float64)
    return Network(x, table["y"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, with_digest: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5 on).

    ``with_digest`` adds text_sha256, by which a caller can join the texts again.
    """
    more = ["text_sha256"] if with_digest else []
    vecs = stash(document_vectors(docs, word_vectors(docs), with_digest), "vectors")
    network = fit(vecs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = flat(batch.column("vec"))[0].view("<f4").reshape(-1, WIDTH).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(network(x), pa.float64()), *map(batch.column, more)], names=["doc_id", "score", *more])

    scores = vecs.mapInArrow(run, "doc_id long, score double" + (", text_sha256 string" if with_digest else ""))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with its own columns, without the rows predicted to be of label 0.

    A row goes by its doc_id, null or not, and its text: another text of the same doc_id stays.
    """
    bad = score_quality(docs, labels, with_digest=True).filter("predicted = 0").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (sha == bad["_sha"]), "left_anti")
