"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained by follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties, then one
temperature is fitted on a part of the sample that training did not see. Document frequencies come from every training
row; only the gradient steps use a bounded sample (max_rows). N-grams are hashed into `dims` buckets, so that the model
and everything that is broadcast have a fixed size.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import bytes_of, claim, is_held_out, may_train, ship_package, slices

UNKNOWN = "und"
DIMS = 1 << 14
ORDERS = (1, 2, 3)
MAX_ROWS = 4000
MAX_LANGUAGES = 256
_PIECE = 1 << 20
_SLICE = 1 << 19


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Counts:
    """Hashed n-gram counts of several texts as sparse rows: places of a text are [first[i], first[i + 1]), in order of buckets."""

    first: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    has_letters: np.ndarray

    def row_sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (one for each place) by text; 0 for a text without places."""
        out = np.zeros(len(self.first) - 1)
        full = np.flatnonzero(np.diff(self.first))
        if len(full):
            out[full] = np.add.reduceat(values, self.first[full])
        return out


def ngram_counts(column: pa.Array, dims: int) -> Counts:
    """Hashed n-gram counts of each text. Anything but letters is a space. Memory follows the texts' length, not rows x dims."""
    raw, offsets = bytes_of(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(offsets) - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    places = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
    alpha = _letters()[points]
    has = np.add.reduceat(np.append(alpha, False), places[:-1]).astype(bool) & (np.diff(places) > 0) if n else np.zeros(0, bool)
    bits = int(dims).bit_length() - 1
    shift = np.uint32(32 - bits)
    kind = np.uint32 if n << bits < 1 << 32 else np.uint64
    found, counts = np.zeros(0, kind), np.zeros(0, np.int64)
    for lo in range(0, len(points), _PIECE):
        hi = min(lo + _PIECE, len(points))
        part = np.where(alpha[lo : hi + max(ORDERS) - 1], points[lo : hi + max(ORDERS) - 1], np.uint32(32))
        begin, end = np.searchsorted(places, [lo, hi - 1], "right") - 1
        inside = np.diff(np.clip(places[begin : end + 2], lo, hi))
        doc = np.repeat(np.arange(begin, end + 1, dtype=kind), inside)
        room = np.repeat(places[begin + 1 : end + 2], inside) - np.arange(lo, hi)
        keys = []
        with np.errstate(over="ignore"):
            h = np.zeros(len(part), np.uint32)
            for k in range(1, max(ORDERS) + 1):
                h = h[: len(part) - k + 1] * np.uint32(0x01000193) + part[k - 1 :]
                if k in ORDERS:
                    m = min(len(h), hi - lo)
                    ok = (room[:m] >= k) & alpha[lo : lo + m] if k == 1 else (room[:m] >= k) & ((part[:m] != 32) | (part[1 : m + 1] != 32))
                    bucket = ((h[:m] + np.uint32(k)) * np.uint32(0x9E3779B1)) >> shift
                    keys.append((doc[:m] << kind(bits) | bucket)[ok])
        keys = np.sort(np.concatenate(keys))
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        own, times = keys[head], np.diff(np.append(head, len(keys)))
        if len(found) and len(own) and own[0] <= found[-1]:  # a text that goes on from the last piece
            found, at = np.unique(np.concatenate((found, own)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, times)), len(found)).astype(np.int64)
        else:
            found, counts = np.concatenate((found, own)), np.concatenate((counts, times))
    first = np.searchsorted(found, np.arange(n + 1, dtype=np.uint64) << np.uint64(bits)) if len(found) else np.zeros(n + 1, np.int64)
    return Counts(first, (found & kind((1 << bits) - 1)).astype(np.int32), counts, has)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    @property
    def tells(self) -> bool:
        """Whether the model recognises anything: not without training rows, nor where these gave no weights to tell languages apart."""
        return bool(self.languages) and (len(self.languages) == 1 or bool(self.weights.any() or self.bias.any()))

    def logits(self, counts: Counts) -> np.ndarray:
        """Texts x languages; only the weights of n-grams that occur are read, a language at a time."""
        x = np.log1p(counts.count) * self.idf[counts.bucket]
        norm = np.maximum(np.sqrt(counts.row_sums(x * x)), 1e-9)
        z = [counts.row_sums(x * column[counts.bucket]) / norm for column in np.ascontiguousarray(self.weights.T)]
        return np.column_stack(z) + self.bias if z else np.zeros((len(norm), 0))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        counts = ngram_counts(column, len(self.idf))
        has = counts.has_letters
        if not self.languages:
            return [UNKNOWN] * len(has), np.zeros(len(has))
        z = self.logits(counts) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)], np.where(has, p.max(1), 0.0).astype(np.float64)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """FTRL-proximal softmax regression on sparse rows (indices, values); returns (dims + 1) x classes, the bias last.

    Before each step only the weights of the row's own features are needed, in closed form from their sums; weights whose
    sums stay below l1 are exactly 0.
    """
    z = np.zeros((dims + 1, classes))
    n = np.zeros((dims + 1, classes))

    def weights(idx: np.ndarray | slice) -> np.ndarray:
        zz, nn = z[idx], n[idx]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            idx, val = np.append(rows[k][0], dims), np.append(rows[k][1], 1.0)
            w = weights(idx)
            s = val @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = val[:, None] * p
            g2 = g * g
            nn = n[idx]
            z[idx] += g - (np.sqrt(nn + g2) - np.sqrt(nn)) / alpha * w
            n[idx] = nn + g2
    return weights(slice(None))


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search over its logarithm."""
    if len(y) == 0:
        return 1.0

    def loss(t: float) -> float:
        s = z / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.log(np.exp(s).sum(1)).mean() - s[np.arange(len(y)), y].mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train_language_model(docs: DataFrame, dims: int = DIMS, max_rows: int = MAX_ROWS, max_languages: int = MAX_LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Train on text and language of rows outside the held-out fold. Without such rows the model knows no language.

    Of more than max_languages languages the most frequent ones are learned; texts in others get the nearest of these, mostly with
    a low score. dims is a power of 2.
    """
    ship_package(docs.sparkSession)
    known = docs.where(may_train(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    languages = sorted(r[0] for r in known.select(F.col(lang_col).cast("string").alias("l")).groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_languages).collect())
    if not languages:
        return LanguageModel([], np.ones(dims), np.zeros((dims, 0)), np.zeros(0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        total, rows = np.zeros(dims, np.int64), 0
        for batch in slices(batches, "text", _SLICE):
            total += np.bincount(ngram_counts(batch.column(0), dims).bucket, minlength=dims)
            rows += batch.num_rows
        at = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(total[at[:-1]], rows), pa.int64())], names=["bucket", "n"])

    df = np.zeros(dims)
    total = 0
    for r in known.select(F.col(text_col).alias("text")).mapInArrow(frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1

    labelled = known.select(F.col(id_col).alias("_id"), F.struct(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("label")).alias("row")).where(F.col("row.label").isin(languages))
    picked = labelled.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(max_rows).distinct()
    # one row of each id, so that the bound holds for rows as well
    sample = labelled.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.text", "row.label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        rows, y = [], []
        for batch in slices(batches, "text", _SLICE):
            counts = ngram_counts(batch.column(0), dims)
            for a, b, label, ok in zip(counts.first, counts.first[1:], batch.column(1).to_pylist(), counts.has_letters, strict=False):
                if ok:
                    idx = counts.bucket[a:b]
                    val = np.log1p(counts.count[a:b]) * idf[idx]
                    rows.append((idx, (val / np.linalg.norm(val)).astype(np.float32)))
                    y.append(languages.index(label))
        y = np.array(y, np.int64)
        spare = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
        w = fit_ftrl([r for r, s in zip(rows, spare, strict=True) if not s], y[~spare], dims, len(languages))
        z = np.array([val @ w[idx] + w[-1] for (idx, val), s in zip(rows, spare, strict=True) if s])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((w[:-1], w[-1], fit_temperature(z, y[spare])))], pa.binary())], names=["model"])

    row = sample.repartition(1).mapInArrow(fit, "model binary").first()
    weights, bias, temperature = pickle.loads(row[0]) if row else (np.zeros((dims, len(languages))), np.zeros(len(languages)), 1.0)
    return LanguageModel(languages, idf, weights, bias, temperature)


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    A NULL text or one without letters is `und` with score 0; so is every text if the model knows no language. Other columns
    are not read; repeated rows give repeated rows; a NULL id is kept and counts as not held out.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        for batch in slices(batches, "text", _SLICE):
            langs, scores = sent.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_known_languages(docs: DataFrame, model: LanguageModel, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole and with the same columns, whose language is recognised with at least min_score.

    A model that recognises nothing, as without a row to train on, drops nothing.
    """
    if not model.tells:
        return docs
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        renamed = (pa.RecordBatch.from_arrays(b.columns, names=[f"c{i}" if i != at else "text" for i in range(len(names))]) for b in batches)
        for batch in slices(renamed, "text", _SLICE):
            langs, scores = sent.value.predict(batch.column(at))
            keep = (np.array(langs) != UNKNOWN) & (scores >= min_score)
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
