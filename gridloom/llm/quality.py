"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text come from one numpy pass over its bytes. Training takes a bounded sample of labelled rows
(``max_train``), bins every statistic by its quantiles, and grows depth-limited trees on gradient histograms. The trees
are flattened into arrays; scoring walks all rows of a batch through a tree one level at a time in numpy.

Null and empty texts have all statistics 0 and get a score. Ties in a label's rows (one id with several labels) each
count as a row. With no labelled training row every score is 0.5; with one class only, the smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, filtered, fold_of, labelled, map_arrow, segment_sum, slices, table, texts, utf8

#: Labelled rows that training takes at most, those with the smallest hash of their id.
MAX_TRAIN = 20_000
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes log_words log_lines upper lower digit punct space newline high bang pipe hash_star quote angle dot comma "
    "word_len word_len_sd long_words one_char_words capital_words words_per_line line_len_sd distinct_words "
    "distinct_lines top_word repeated_pairs distinct_trigrams punct_ended_words"
).split()

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 punctuation, 5 space, 6 newline, 7 beyond ASCII
_CLASS[33:127] = 4
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 5, 6
_MARKS = {"bang": b"!", "pipe": b"|", "hash_star": b"#$%&*", "quote": b"\"'", "angle": b"<>{}[]\\", "dot": b".?", "comma": b",;:"}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def runs(is_in: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the offsets."""
    if not len(is_in):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(is_in) + 1, bool)
    first[offsets[:-1]] = True
    before = np.concatenate([[False], is_in[:-1]])
    start = is_in & (~before | first[:-1])
    after = np.concatenate([is_in[1:], [False]])
    end = is_in & (~after | first[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, by prefix sums of a polynomial in a fixed odd base."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data) + 1, 0x100000001B3, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        out = (sums[ends] - sums[starts]) * power[len(data) - starts]  # the same for equal spans wherever they lie
        out ^= out >> np.uint64(32)
        out *= _MIX
        return out ^ (out >> np.uint64(29))


def _share_distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: distinct keys over keys, and the share of its most frequent key."""
    count = np.bincount(doc, minlength=n).astype(float)
    distinct, top = np.ones(n), np.zeros(n)
    if len(key):
        order = np.lexsort((key, doc))
        d, k = doc[order], key[order]
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
        size = np.diff(np.r_[new, len(d)])
        has = count > 0
        distinct[has] = np.bincount(d[new], minlength=n)[has] / count[has]
        np.maximum.at(top, d[new], size)
        top[has] /= count[has]
    return distinct, top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, offsets = utf8(column)
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    kind = _CLASS[data]
    per = np.maximum(size, 1)
    out = {"log_bytes": np.log1p(size)}
    for code, name in enumerate("upper lower digit punct space newline high".split(), 1):
        out[name] = segment_sum((kind == code).astype(np.int64), offsets) / per
    for name, chars in _MARKS.items():
        mark = np.zeros(256, np.int64)
        mark[np.frombuffer(chars, np.uint8)] = 1
        out[name] = segment_sum(mark[data], offsets) / per

    starts, ends = runs((kind != 5) & (kind != 6), offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(doc, minlength=n).astype(float)
    per_word, length = np.maximum(words, 1), (ends - starts).astype(float)
    mean = lambda x: np.bincount(doc, weights=x, minlength=n) / per_word
    out["log_words"] = np.log1p(words)
    out["word_len"] = mean(length)
    out["word_len_sd"] = np.sqrt(np.maximum(0, mean(length**2) - out["word_len"] ** 2))
    out["long_words"], out["one_char_words"] = mean(length > 14), mean(length == 1)
    out["capital_words"] = mean(kind[starts] == 1)
    out["punct_ended_words"] = mean(kind[ends - 1] == 4)
    key = span_hash(data, starts, ends)
    out["distinct_words"], out["top_word"] = _share_distinct(doc, key, n)
    with np.errstate(over="ignore"):
        for name, k in (("repeated_pairs", 2), ("distinct_trigrams", 3)):
            if len(key) >= k:
                same = doc[k - 1 :] == doc[: len(doc) - k + 1]
                gram = key[k - 1 :].copy()
                for j in range(k - 1):
                    gram = (gram * np.uint64(31)) ^ (key[j : len(key) - k + 1 + j] * _MIX)
                out[name] = _share_distinct(doc[k - 1 :][same], gram[same], n)[0]
            else:
                out[name] = np.ones(n)

    starts, ends = runs(kind != 6, offsets)
    line = np.searchsorted(offsets, starts, side="right") - 1
    lines, length = np.bincount(line, minlength=n).astype(float), (ends - starts).astype(float)
    per_line = np.maximum(lines, 1)
    first, second = (np.bincount(line, weights=x, minlength=n) / per_line for x in (length, length**2))
    out["log_lines"], out["words_per_line"] = np.log1p(lines), words / per_line
    out["line_len_sd"] = np.sqrt(np.maximum(0, second - first**2))
    out["distinct_lines"] = _share_distinct(line, span_hash(data, starts, ends), n)[0]
    return np.column_stack([out[name] for name in STATISTICS]).astype(np.float32) if n else np.zeros((0, len(STATISTICS)), np.float32)


@dataclass
class Forest:
    """Trees as arrays: node i of tree t splits statistic feature[t, i] at cut[t, i] into nodes 2i+1 and 2i+2; nodes of
    the last level are leaves with value[t, i]. base: log-odds before any tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 48, rate: float = 0.08, ridge: float = 4.0, least: int = 12) -> Forest:
    """Gradient boosting of the logistic loss; every split maximises the usual gain on histograms of gradients."""
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    forest = Forest(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), depth)
    if not len(y) or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64)
    features, values, places = [], [], []
    total, width = np.full(len(y), forest.base), x.shape[1]
    flat = binned + np.arange(width) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at, feature, place = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            nodes, low = 2**level, 2**level - 1
            index = ((at - low) * (width * bins))[:, None] + flat
            hist = [np.bincount(index.ravel(), weights=np.repeat(w, width), minlength=nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2) for w in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (gt, ht, nt) = hist, [a[:, :, -1:] for a in hist]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, c = divmod(int(b), bins)
                if gain[k, j, c] > 1e-9 and c < len(cuts[j]):
                    feature[low + k], place[low + k] = j, cuts[j][c]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > place[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        total += value[leaf]
        features.append(feature)
        places.append(place)
        values.append(value)
    return Forest(forest.base, np.array(features), np.array(places), np.array(values), depth)


def learn(docs: DataFrame, labels: DataFrame, label: str, train, most: int = MAX_TRAIN) -> Forest:
    """The forest of at most ``most`` labelled training rows."""

    def step(batches):
        for batch in batches:
            for part in slices(batch):
                x = statistics(part.column("text"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATISTICS)), pa.int32()), pa.array(x.ravel()))
                yield batch_of(doc_id=part.column("doc_id"), y=part.column("y"), stats=flat)

    found = map_arrow(labelled(docs, labels, label, train, most), step, "doc_id long, y int, stats array<float>").toPandas()
    if found.empty:
        return fit(np.zeros((0, len(STATISTICS)), np.float32), np.zeros(0))
    found = found.sort_values(["doc_id", "y"], kind="stable")  # the same sums on each run
    return fit(np.stack(found["stats"].to_numpy()).astype(np.float32), (found["y"].to_numpy() > 0).astype(float))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, label: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """Scores every document; learns from labelled rows outside the held-out fold.

    Returns doc_id, held_out, score, predicted: one row for each row of ``docs``. An empty table gives no rows.
    """
    rows = texts(docs)
    forest = learn(rows, labels, label, fold_of("doc_id", folds) != held, max_train)

    def step(batches):
        for batch in batches:
            for part in slices(batch):
                score = forest.score(statistics(part.column("text")))
                yield batch_of(doc_id=part.column("doc_id"), score=pa.array(score), predicted=pa.array((score >= THRESHOLD).astype(np.int32)))

    out = map_arrow(rows, step, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    forest = learn(texts(docs), labels, "quality", fold_of("doc_id", folds) != held)
    return filtered(docs, lambda text: forest.score(statistics(text)) >= THRESHOLD)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
