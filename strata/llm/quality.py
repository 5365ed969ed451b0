"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's potentials come from its own features and those of its neighbours, a transition matrix couples adjacent labels.
Forward-backward gives each line's marginal; their length-weighted mean, after one logistic step fitted on the labels, is the
document's score. Only document labels exist, so training gives each line its document's label. All line features are
computed on byte arrays, for many texts at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import NONSPACE, bytes_of, claim, fit_logistic, is_held_out, labelled_sample, predict_logistic, ship_package, slices, word_hashes, word_spans

THRESHOLD = 0.7
MAX_ROWS = 8000
MAX_LINES = 500_000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True

NAMES = ("length", "words", "mark share", "lone marks", "double marks", "upper share", "digit share", "same as last word", "repeats", "word length", "ends as a sentence", "begins upper", "short", "same as last line", "spaces")
K = len(NAMES)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, the lines' byte lengths, and each text's first line (n + 1 values)."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    # a break at a text's last byte begins an empty line there, just before the next text's start
    first = np.searchsorted(breaks, offsets) + np.arange(n + 1)
    first[-1] = len(starts)
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[-1] = len(data)
    last = first[1:] - 1
    ends[last] = offsets[1:]
    lengths = ends - starts

    def counted(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(flags)))
        return (run[ends] - run[starts]).astype(float)

    marks = _MARK[data]
    double = np.zeros(len(data), bool)
    if len(data):
        double[1:] = marks[1:] & (data[1:] == data[:-1])
    letters = counted(_LETTER[data])
    ws, we, _ = word_spans(data, np.append(starts, len(data)) if len(starts) else np.zeros(1, np.int64), NONSPACE)
    line = np.searchsorted(starts, ws, "right") - 1
    # several empty lines share a start with a full one: the last of them holds the words
    words = np.bincount(line, minlength=len(starts)).astype(float)
    h = word_hashes(data, ws, we)
    lone = np.zeros(len(starts))
    again = np.zeros(len(starts))
    same = np.zeros(len(starts))
    line_hash = np.zeros(len(starts), np.uint64)
    if len(ws):
        lone += np.bincount(line[marks[ws] & (we - ws == 1)], minlength=len(starts))
        adjacent = np.flatnonzero((h[1:] == h[:-1]) & (line[1:] == line[:-1])) + 1
        again += np.bincount(line[adjacent], minlength=len(starts))
        with np.errstate(over="ignore"):
            keyed = np.sort((line.astype(np.uint64) << np.uint64(40)) ^ (h >> np.uint64(24)))
            distinct = np.bincount((keyed[np.concatenate(([True], keyed[1:] != keyed[:-1]))] >> np.uint64(40)).astype(np.int64), minlength=len(starts))
            place = np.arange(len(ws)) - np.searchsorted(line, line)
            np.add.at(line_hash, line, h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        same = words - distinct
    w = np.maximum(words, 1)
    size = np.maximum(lengths, 1)
    ended = np.zeros(len(starts))
    begun = np.zeros(len(starts))
    full = lengths > 0
    ended[full] = np.isin(data[ends[full] - 1], np.frombuffer(b".!?", np.uint8))
    begun[full] = _UPPER[data[starts[full]]] | (data[starts[full]] >= 128)
    copied = np.zeros(len(starts))
    copied[1:] = (line_hash[1:] == line_hash[:-1]) & full[1:] & (words[1:] > 0)
    copied[first[:-1]] = 0
    x = np.column_stack([
        np.log1p(lengths) / 6, np.log1p(words) / 5, counted(marks) / size * 4, lone / w * 4, counted(double) / w * 2, counted(_UPPER[data]) / np.maximum(letters, 1) * 2, counted(_DIGIT[data]) / size * 4,
        again / w * 2, same / w, lengths / w / 10, ended, begun, words < 4, copied, 1 - np.minimum(1, (lengths - words) / size),
    ])
    return np.clip(x, 0, 3), lengths, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (0 at a text's ends), whether such lines exist, 1."""
    before, after, has = np.zeros_like(x), np.zeros_like(x), np.ones((len(x), 2))
    before[1:], after[:-1] = x[:-1], x[1:]
    begin, end = first[:-1], first[1:] - 1
    before[begin], after[end] = 0, 0
    has[begin, 0], has[end, 1] = 0, 0
    return np.hstack([x, before, after, has, np.ones((len(x), 1))])


_BLOCK = 64
_MOST = 40.0


def _scan(m: np.ndarray) -> np.ndarray:
    """Normalised row vectors of the running products m[0] m[1] ... m[k], for each k; m: n x 2 x 2, not negative.

    A parallel scan: products inside blocks of lines, all blocks at once, then the same over the blocks' products, so that a text of
    any number of lines takes a few hundred array steps.
    """
    n = len(m)
    blocks = -(-n // _BLOCK)
    p = np.empty((blocks * _BLOCK, 2, 2))
    p[:n], p[n:] = m, np.eye(2)
    p = p.reshape(blocks, _BLOCK, 2, 2)
    p /= p.max((2, 3), keepdims=True)
    for k in range(1, _BLOCK):
        x = p[:, k - 1, :, :1] * p[:, k, :1] + p[:, k - 1, :, 1:] * p[:, k, 1:]
        p[:, k] = x / x.max((1, 2), keepdims=True)
    before = np.full((blocks, 2), 0.5)
    if blocks > 1:
        before[1:] = _scan(p[:-1, -1])
    v = before[:, None, :1] * p[:, :, 0] + before[:, None, 1:] * p[:, :, 1]
    v = v.reshape(-1, 2)[:n]
    return v / v.sum(1, keepdims=True)


def forward_backward(e: np.ndarray, trans: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of many chains at once; chains are [first[i], first[i + 1]), none of them empty.

    e: potentials (lines x 2), whose difference counts up to 40 either way. Returns marginals (lines x 2), the summed pair
    marginals (2 x 2; each pair times its chain's weight, if given) and the log partition of each chain.
    """
    n = len(e)
    if not n:
        return np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(0)
    middle = e.mean(1, keepdims=True)
    shifted = middle + np.clip(e - middle, -_MOST / 2, _MOST / 2)
    top = shifted.max(1, keepdims=True)
    u = np.exp(shifted - top)
    base = trans.max()
    t = np.exp(trans - base)
    begin, end = np.zeros(n, bool), np.zeros(n, bool)
    begin[first[:-1]] = end[first[1:] - 1] = True
    ahead = t[None] * u[:, None, :]
    ahead[begin] = u[begin][:, None, :]  # equal rows: what came before does not matter
    a = _scan(ahead)
    back = np.ones((n, 2, 2))
    back[~end] = t.T[None] * u[1:][~end[:-1]][:, :, None] if n > 1 else 1.0
    b = _scan(back[::-1])[::-1]
    p = a * b
    p /= p.sum(1, keepdims=True)
    i = np.flatnonzero(~begin)
    joint = a[i - 1][:, :, None] * t[None] * (u[i] * b[i])[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    if weight is not None:
        joint *= np.repeat(weight, np.diff(first))[i][:, None, None]
    # a chain's partition is the product of its messages' normalisers
    norm = np.empty(n)
    norm[begin] = u[begin].sum(1)
    norm[i] = (a[i - 1][:, :, None] * t[None] * u[i][:, None, :]).sum((1, 2))
    return p, joint.sum(0), np.add.reduceat(np.log(norm) + top[:, 0] + np.where(begin, 0.0, base), first[:-1])


@dataclass
class QualityModel:
    weights: np.ndarray
    trans: np.ndarray
    calibration: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = np.zeros((len(x), 2))
        e[:, 1] = with_neighbours(x, first) @ self.weights
        return forward_backward(e, self.trans, first)[0][:, 1]

    def aggregate(self, p: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, as logit."""
        w = lengths + 1e-3
        q = np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1]) if len(first) > 1 else np.zeros(0)
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))[:, None]

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's score, its lines, and how many of them are good ones (marginal at least 0.5)."""
        data, offsets = bytes_of(column)
        x, lengths, first = line_features(data, offsets)
        p = self.marginals(x, first)
        good = np.add.reduceat((p >= 0.5).astype(np.int64), first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)
        return predict_logistic(self.aggregate(p, lengths, first), self.calibration), np.diff(first), good


def _untrained() -> QualityModel:
    return QualityModel(np.zeros(3 * K + 3), np.zeros((2, 2)), np.zeros(2))


def crf_loss(w: np.ndarray, t: np.ndarray, f: np.ndarray, first: np.ndarray, y: np.ndarray, l2: float, l2_trans: float) -> tuple[float, np.ndarray]:
    """The objective and its gradient (weights, then transitions).

    The objective is the mean over chains of the negative log-likelihood of a chain's labels divided by its lines, so that chains
    count alike, plus half of l2 times the squared weights and of l2_trans times the squared transitions.
    """
    size = np.diff(first)
    weight = 1 / (size * max(1, len(size)))
    line = np.repeat(weight, size)
    e = np.zeros((len(f), 2))
    e[:, 1] = f @ w
    p, pairs, z = forward_backward(e, t, first, weight)
    inner = np.ones(len(f), bool)
    inner[first[:-1]] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i - 1], y[i]), line[i])
    loss = weight @ z - line @ e[np.arange(len(e)), y] - (seen * t).sum() + l2 / 2 * (w @ w) + l2_trans / 2 * (t * t).sum()
    return float(loss), np.r_[f.T @ ((p[:, 1] - y) * line) + l2 * w, (pairs - seen + l2_trans * t).ravel()]


def fit_crf(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 200, l2: float = 1e-4, l2_trans: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Penalised conditional maximum likelihood (crf_loss) by full-batch Adam; y is a label for each line."""
    f = with_neighbours(x, first)
    w, t = np.zeros(f.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):
        _, g = crf_loss(w, t, f, first, y, l2, l2_trans)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, t = w - step[:-4], t - step[-4:].reshape(2, 2)
    return w, t


def train_quality_model(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_lines: int = MAX_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Train on at most max_rows labelled rows outside the held-out fold. Without any, every score is 0.5.

    The sample is also bounded in lines: texts are taken in the order of their ids' hashes, and one that would pass max_lines in
    total is left out of it.
    """
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, max_rows, id_col, text_col)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        xs, sizes, lens, y = [], [], [], []
        total = 0
        for batch in slices(batches, "text"):
            x, lengths, first = line_features(*bytes_of(batch.column(0)))
            size = np.diff(first)
            taken = np.zeros(len(size), bool)
            for k, n in enumerate(size.tolist()):
                taken[k] = total + n <= max_lines
                total += n * bool(taken[k])
            lines = np.repeat(taken, size)
            xs.append(x[lines])
            lens.append(lengths[lines])
            sizes.append(size[taken])
            y += batch.column(1).filter(pa.array(taken)).to_pylist()
        model = _untrained()
        if y:
            x, lengths, y = np.vstack(xs), np.concatenate(lens), np.array(y)
            size = np.concatenate(sizes)
            first = np.concatenate(([0], np.cumsum(size)))
            model.weights, model.trans = fit_crf(x, first, np.repeat(y, size))
            model.calibration = fit_logistic(model.aggregate(model.marginals(x, first), lengths, first), y.astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    row = sample.repartition(1).sortWithinPartitions(F.xxhash64("_id")).select("text", "label").mapInArrow(fit, "model binary").first()
    return pickle.loads(row[0]) if row else _untrained()


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= threshold), good_lines, bad_lines (as labelled).

    A NULL or empty text is one empty line. Other columns are not read; repeated rows give repeated rows; a NULL id is kept
    and counts as not held out.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in slices(batches, "text"):
            s, n, good = sent.value.score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(good), pa.array(n - good)], names=["doc_id", "held_out", "score", "predicted", "good_lines", "bad_lines"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, good_lines bigint, bad_lines bigint")
