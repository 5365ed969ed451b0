import itertools
import time

import numpy as np
import pyarrow as pa

from strata.llm.common import bytes_of
from strata.llm.quality import NAMES, crf_loss, fit_crf, forward_backward, line_features, score_quality, train_quality_model
from tests.llm.helpers import held_out, rng, table, words


def test_lines():
    texts = ["a b\nc\n\nd", None, "", "\n", "x", "\n\n", "abc\n", "last A!! | |"]
    x, lengths, first = line_features(*bytes_of(pa.array(texts)))
    lines = [s for t in texts for s in (t or "").split("\n")]
    assert lengths.tolist() == [len(s) for s in lines] and np.diff(first).tolist() == [len((t or "").split("\n")) for t in texts]
    assert np.allclose(x[:, 1] * 5, [np.log1p(len(s.split())) for s in lines])
    assert x[-1, NAMES.index("double marks")] > 0 and x[-1, NAMES.index("lone marks")] > 0


def test_features_see_repeats():
    x, _, _ = line_features(*bytes_of(pa.array(["go go go go", "go on to it\ngo on to it"])))
    same, rep, copied = (NAMES.index(n) for n in ("same as last word", "repeats", "same as last line"))
    assert x[0, same] == 1.5 and x[0, rep] == 0.75 and x[1, same] == 0 and x[:, copied].tolist() == [0, 0, 1]


def test_forward_backward_is_exact():
    r = np.random.default_rng(2)
    sizes = [1, 4, 2, 5]
    first = np.concatenate(([0], np.cumsum(sizes)))
    e, t = r.normal(size=(first[-1], 2)), r.normal(size=(2, 2))
    p, pairs, z = forward_backward(e, t, first)
    want, want_pairs = np.zeros_like(p), np.zeros((2, 2))
    for c, n in enumerate(sizes):
        total = 0.0
        for y in itertools.product((0, 1), repeat=n):
            s = np.exp(sum(e[first[c] + i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in itertools.pairwise(y)))
            total += s
            for i, k in enumerate(y):
                want[first[c] + i, k] += s / 1
            for a, b in itertools.pairwise(y):
                want_pairs[a, b] += s / 1
        assert np.isclose(np.log(total), z[c])
    # normalise by chain
    for c, n in enumerate(sizes):
        want[first[c] : first[c + 1]] /= np.exp(z[c])
    assert np.allclose(p, want) and np.isclose(pairs.sum(), sum(n - 1 for n in sizes))


def test_crf_learns_neighbours():
    x = np.zeros((40, len(NAMES)))
    x[::4, 0] = 1
    y = np.repeat([1, 0], 20)
    x[:20, 1] = 1
    w, t = fit_crf(x, np.arange(0, 41, 4), y)
    assert w[1] > 0 and t[0, 0] > t[0, 1] and t[1, 1] > t[1, 0]


def test_gradient_is_that_of_the_objective():
    r = np.random.default_rng(4)
    sizes = [1, 7, 3, 150]
    first = np.concatenate(([0], np.cumsum(sizes)))
    f, y = r.normal(size=(first[-1], 4)), r.integers(0, 2, first[-1])
    w, t = r.normal(size=4), r.normal(size=(2, 2))
    _, g = crf_loss(w, t, f, first, y, 0.3, 0.7)
    for k in range(8):
        step = np.zeros(8)
        step[k] = 1e-6
        up, down = (crf_loss(w + s * step[:4], t + s * step[4:].reshape(2, 2), f, first, y, 0.3, 0.7)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[k]) < 1e-6


def test_long_chains_equal_plain_recursion_and_take_seconds():
    r = np.random.default_rng(6)
    sizes = [1, 50_000, 3, 64, 65, 128]
    first = np.concatenate(([0], np.cumsum(sizes)))
    e, t = 3 * r.normal(size=(first[-1], 2)), r.normal(size=(2, 2))
    begun = time.monotonic()
    p, _, z = forward_backward(e, t, first)
    assert time.monotonic() - begun < 5
    for c in range(len(sizes)):
        own = e[first[c] : first[c + 1]]
        a = own.copy()
        for k in range(1, len(own)):
            a[k] += np.logaddexp(a[k - 1, 0] + t[0], a[k - 1, 1] + t[1])
        assert np.isclose(np.logaddexp(*a[-1]), z[c])
        last = np.exp(a[-1] - np.logaddexp(*a[-1]))
        assert np.allclose(p[first[c + 1] - 1], last)


def test_fitting_on_a_long_text_is_bounded_in_time():
    x = np.random.default_rng(0).random((50_000, len(NAMES)))
    begun = time.monotonic()
    fit_crf(x, np.array([0, 25_000, 50_000]), np.repeat([0, 1], 25_000), rounds=20)
    assert time.monotonic() - begun < 30


def corpus(spark):
    r = rng(8)
    texts, labels = [], []
    for k in range(240):
        good = k % 3 > 0
        line = lambda: words(r, 12).capitalize() + "."
        junk = lambda: " | ".join(words(r, 8).split()) + " |"
        texts.append("\n".join(line() if good or j == 0 else junk() for j in range(6)))
        labels.append(int(good))
    return texts, labels, spark.createDataFrame([(k, x, 0) for k, x in enumerate(labels)] + [(None, 1, 0), (3, None, 0)], "doc_id BIGINT, quality INT, toxic INT")


def test_held_out(spark):
    texts, want, labels = corpus(spark)
    extra = [(700, None), (701, ""), (702, "\n".join([texts[1]] * 3000)), (None, texts[1]), (4, texts[4])]
    docs = table(spark, texts + extra)
    model = train_quality_model(docs, labels)
    got = score_quality(docs, model).collect()
    assert len(got) == len(texts) + len(extra) and all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) for r in got)
    assert all(r.predicted == want[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 240)
    by = {r.doc_id: r for r in got}
    assert by[702].good_lines + by[702].bad_lines == 18_000 and by[700].good_lines + by[700].bad_lines == 1
    few = train_quality_model(docs, labels, max_lines=300)
    assert np.isfinite(few.weights).all() and few.weights.any()
    assert by[702].predicted == 1 and by[None].predicted == 1 and by[700].score == by[701].score


def test_held_out_labels_are_not_used(spark):
    texts, want, labels = corpus(spark)
    other = spark.createDataFrame([(k, 1 - x if held_out(k) else x) for k, x in enumerate(want)], "doc_id BIGINT, quality INT")
    a, b = (train_quality_model(table(spark, texts), x) for x in (labels, other))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.calibration, b.calibration)


def test_no_labels(spark):
    docs = table(spark, ["a", None])
    model = train_quality_model(docs, spark.createDataFrame([], "doc_id BIGINT, quality INT"))
    assert [r.score for r in score_quality(docs, model).collect()] == [0.5, 0.5]
