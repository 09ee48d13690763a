"""Quality by hierarchical empirical Bayes.

A logistic classifier gives each document evidence from its text alone. Sites are learnt from all documents: the
evidence summed over a path (site and language) and over a host is a Beta posterior, shrunk to the level above
(path to host, host to the whole) with a strength estimated from the spread between the groups (method of moments), so that
sparse groups are moved to their parent's rate. A document's odds are its own times those of its path over the prior's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import cut
from .textkit import WHITE, pieces, spans_hash

MAX_TRAIN = 12_000
FEATURES = ["upper", "symbol", "digit", "word_length", "log_words", "end_mark", "repeat_line", "repeat_word", "long_word"]
_UPPER, _DIGIT, _SYMBOL, _MARK = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[[*b"#$%&*!@^~|<>{}[]\\=+_"]] = 1
_MARK[[*b".,;:?"]] = 1


def _features(p) -> np.ndarray:
    """Per row of the piece, the FEATURES; of an empty text zeros."""
    p.words()
    o, n_rows = p.offsets, len(p.offsets) - 1
    size = np.maximum(np.diff(o), 1)

    def share(table):
        sums = np.concatenate([[0], np.cumsum(table[p.data])])
        return (sums[o[1:]] - sums[o[:-1]]) / size

    words = np.diff(p.first)
    length = p.ends - p.starts
    per = np.maximum(words, 1)

    def by_row(x):
        return np.bincount(p.row, weights=x, minlength=n_rows)

    h = p.word_hashes()

    def repeats(hashes, row):
        """Share of items that another before them in the row equals."""
        if not len(hashes):
            return np.zeros(n_rows)
        order = np.lexsort((hashes, row))
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
        return np.bincount(row[order], weights=same, minlength=n_rows) / np.maximum(np.bincount(row, minlength=n_rows), 1)

    line = p.data == 10
    ends = np.union1d(np.flatnonzero(line), o[1:][o[1:] > 0] - 1) if len(p.data) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    long_enough = ends - starts > 20
    line_row = np.searchsorted(o, starts[long_enough], "right") - 1
    line_hash = spans_hash(p.data, starts[long_enough], ends[long_enough])
    upper = share(_UPPER)
    x = np.stack([upper, share(_SYMBOL), share(_DIGIT), by_row(length) / per / 10, np.log1p(words) / 10, share(_MARK), repeats(line_hash, line_row), repeats(h, p.row), by_row(length > 24) / per], axis=1)
    x[words == 0] = 0
    return x


def train(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton's method on squares too; the weights, of the constant last."""
    x, y = _design(x), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        w = np.zeros(x.shape[1] if len(y) else 2 * len(FEATURES) + 1)
        w[-1] = 0.0 if not len(y) else (5.0 if y[0] else -5.0)
        return w
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.05)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step / max(1.0, np.abs(step).max() / 20)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _design(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).reshape(-1, len(FEATURES))
    return np.hstack([x, np.sqrt(x), np.ones((len(x), 1))])


def features(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for p in pieces(batches):
            x = _features(p)
            yield pa.RecordBatch.from_arrays([p.rows.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """The text classifier's weights, from max_train labelled documents, those of least id hash.

    Rows of null id, text or label are left out; of an id's labels the largest counts and of its texts the least; ties of the hash are
    broken by id. Without rows the evidence is even, with one label only it is that label's. Extra columns don't matter.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(label).alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    rows = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))  # one text an id: repeated ids don't add to what the driver gets
    table = features(rows, "_label", "_text").toArrow()
    return train(np.array(table["x"].to_pylist()), table["doc_id"].to_numpy())


def evidence(docs: DataFrame, weights: np.ndarray, id: str, text: str, host: str, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for p in pieces(batches):
            score = 1 / (1 + np.exp(-np.clip(_design(_features(p)) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[p.rows.column(k) for k in range(3)], pa.array(score)], ["doc_id", "host", "path", "evidence"])

    kinds = dict(docs.dtypes)
    chosen = docs.select(F.col(id).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kinds[id]}, host {kinds[host]}, path {kinds[path]}, evidence double")


def _strength(groups: DataFrame, mean: str) -> DataFrame:
    """One row: prior strength k of Beta(k m, k (1 - m)) from groups (n, s), by moments; 1 at least and 10000 at most."""
    m = F.col(mean)
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2)) / F.sum("n")
    within = F.sum(m * (1 - m)) / F.sum("n")
    between = F.greatest(spread - within, F.lit(1e-6))
    return groups.agg(F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.avg(m * (1 - m)) / between - 1)).alias("k"))


def posteriors(docs: DataFrame, weights: np.ndarray, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, quality, keep) of every row of docs.

    path is a level below host. Null hosts and paths are groups of their own, null and empty texts have the evidence of
    an empty text, and repeated rows count each time. keep: quality is 0.5 at least. No rows give no rows.
    """
    # the scores are small, and two levels of aggregates and the result all need them
    scored = cut(evidence(docs, weights, id, text, host, path))
    by_path = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s"))
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = by_host.agg((F.sum("s") / F.sum("n")).alias("prior"))
    host_in = by_host.crossJoin(whole)  # one row
    hosts = host_in.crossJoin(_strength(host_in, "prior")).select(F.col("host").alias("_host"), "prior", ((F.col("s") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k"))).alias("host_rate"))
    path_in = by_path.join(hosts, by_path.host.eqNullSafe(F.col("_host")))
    paths = path_in.crossJoin(_strength(path_in, "host_rate")).select("_host", F.col("path").alias("_path"), "prior", "host_rate", ((F.col("s") + F.col("k") * F.col("host_rate")) / (F.col("n") + F.col("k"))).alias("path_rate"))
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(bound(c) / (1 - bound(c)))
    joined = scored.join(paths, scored.host.eqNullSafe(F.col("_host")) & scored.path.eqNullSafe(F.col("_path")))
    odds = logit(F.col("evidence")) + logit(F.col("path_rate")) - logit(F.col("prior"))
    out = joined.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("quality"))
    return out.select("*", (F.col("quality") >= 0.5).alias("keep"))
