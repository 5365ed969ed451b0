import math
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import language as L
from strata.llm.language import LanguageModel, fit_ftrl, fit_temperature, keep_known_languages, predict_language, train_language_model
from tests.llm.helpers import held_out, rng, rows, table

STEMS = {"en": ["the", "ing", "tion", "wh"], "de": ["der", "sch", "ung", "ß"], "fr": ["eau", "é", "oux", "ç"]}


def corpus():
    r = rng(1)
    out, langs = [], []
    for k in range(240):
        lang = list(STEMS)[k % 3]
        out.append(" ".join("".join(r.choices(STEMS[lang], k=3)) for _ in range(30)))
        langs.append(lang)
    return out, langs


def test_held_out_accuracy(spark):
    texts, langs = corpus()
    extra = [(900, None), (901, ""), (902, "12 34 !?"), (903, "the ing " * 20_000), (None, "der schung"), (903, "the ing " * 20_000)]
    docs = table(spark, texts + extra, langs + [None] * len(extra))
    model = train_language_model(docs)
    assert model.languages == ["de", "en", "fr"] and 0.05 <= model.temperature <= 20
    got = predict_language(docs, model).collect()
    assert len(got) == len(texts) + len(extra)
    assert all(r.lang_pred == langs[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 240)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert by[900] == by[901] == by[902] == ["und"] and by[903] == ["en", "en"] and by[None] == ["de"]
    kept = keep_known_languages(docs, model)
    assert kept.columns == docs.columns and kept.count() == 240 + 3


def test_labels_of_held_out_rows_are_not_used(spark):
    texts, langs = corpus()
    wrong = ["en" if held_out(k) else x for k, x in enumerate(langs)]
    a, b = (train_language_model(table(spark, texts, x)) for x in (langs, wrong))
    assert np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_nothing_to_learn_from(spark):
    docs = table(spark, ["abc", None])
    model = train_language_model(docs)
    assert model.languages == [] and rows(predict_language(docs, model), "doc_id", "lang_pred", "score") == [(0, "und", 0.0), (1, "und", 0.0)]
    empty = table(spark, ["x"]).limit(0)
    assert predict_language(empty, train_language_model(empty)).count() == 0


def grams(text):
    """Hashed n-gram counts the plain way."""
    c = Counter()
    t = "".join(x if x.isalpha() else " " for x in (text or "").lower())
    for k in (1, 2, 3):
        for i in range(len(t) - k + 1):
            g = t[i : i + k]
            if g[:2].strip():
                h = 0
                for x in g:
                    h = (h * 0x01000193 + ord(x)) % 2**32
                c[(((h + k) * 0x9E3779B1) % 2**32) >> 32 - 12] += 1
    return c


def as_counter(counts, k):
    a, b = counts.first[k : k + 2]
    return Counter(dict(zip(counts.bucket[a:b].tolist(), counts.count[a:b].tolist(), strict=True)))


TEXTS = ["Der schöne Straßenzug. " * 40, None, "é", "", " 1 ", "x", "naïve, ÉTÉ-2 中文 ÿ", "ab", "", None]


@pytest.mark.parametrize("piece", [1 << 20, 37, 1, 3])
def test_counts_against_brute_force(monkeypatch, piece):
    monkeypatch.setattr(L, "_PIECE", piece)
    counts = L.ngram_counts(pa.array(TEXTS), 1 << 12)
    assert [as_counter(counts, k) for k in range(len(TEXTS))] == [grams(t) for t in TEXTS]
    assert counts.has_letters.tolist() == [any(map(str.isalpha, t or "")) for t in TEXTS]
    none = L.ngram_counts(pa.array([], pa.string()), 1 << 12)
    assert none.first.tolist() == [0] and len(none.bucket) == 0


def test_scores_against_plain_tf_idf(spark):
    """The whole operator against dictionaries: frequencies, weights times TF-IDF, softmax at the temperature."""
    texts, langs = corpus()
    texts += TEXTS
    langs += [None] * len(TEXTS)
    docs = table(spark, texts, langs)
    model = train_language_model(docs, dims=1 << 12)
    training = [t for k, t in enumerate(texts) if langs[k] and not held_out(k)]
    df = Counter(g for t in training for g in grams(t))
    idf = [math.log((1 + len(training)) / (1 + df[g])) + 1 for g in range(1 << 12)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_language(docs, model).collect()}
    for k, t in enumerate(texts):
        x = {g: math.log1p(n) * idf[g] for g, n in grams(t).items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        z = [(sum(v * model.weights[g, c] for g, v in x.items()) / norm + model.bias[c]) / model.temperature for c in range(3)]
        p = [math.exp(v - max(z)) for v in z]
        best = p.index(max(p))
        want = (model.languages[best], max(p) / sum(p)) if any(map(str.isalpha, t or "")) else ("und", 0.0)
        assert got[k][0] == want[0] and abs(got[k][1] - want[1]) < 1e-9


def test_more_languages_than_the_bound_still_answer(spark):
    texts, langs = corpus()
    docs = table(spark, texts + ["der der"], langs + ["zz"])
    model = train_language_model(docs, max_languages=2)
    assert len(model.languages) == 2 and {r.lang_pred for r in predict_language(docs, model).collect()} <= set(model.languages)


def test_one_id_with_many_rows_fills_no_sample(spark):
    texts, langs = corpus()
    docs = table(spark, [*enumerate(texts), *((0, f"the ing {k}") for k in range(300))], langs + ["en"] * 300)
    model = train_language_model(docs, max_rows=50)
    assert model.languages == ["de", "en", "fr"] and model.weights.any()


def test_memory_of_short_texts():
    """10,000 short or empty texts in one batch: memory follows their letters, not rows x buckets."""
    code = """
import resource, pyarrow as pa, numpy as np
from strata.llm import language as L
from strata.llm.common import slices
m = L.LanguageModel(["a", "b"], np.ones(L.DIMS), np.ones((L.DIMS, 2)), np.zeros(2))
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
batch = pa.RecordBatch.from_pydict({"text": ["", "ab", None, "the ing"] * 2500})
n = sum(len(m.predict(b.column(0))[0]) for b in slices(iter([batch]), "text", L._SLICE))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n == 10_000 and mb < 100


def test_ftrl_is_sparse_and_temperature_calibrates():
    r = np.random.default_rng(0)
    rows_, y = [], []
    for k in range(300):
        c = k % 2
        idx = np.array([c, 2 + r.integers(50)])
        rows_.append((idx, np.array([1.0, 0.05])))
        y.append(c)
    w = fit_ftrl(rows_, np.array(y), 100, 2)
    assert (w[:2] != 0).all() and (w[52:100] == 0).all()
    z = np.array([[5.0, 0.0]] * 80 + [[0.0, 5.0]] * 20)
    assert fit_temperature(z, np.zeros(100, int)) > 2
    assert isinstance(LanguageModel([], np.ones(4), np.zeros((4, 0)), np.zeros(0)), LanguageModel)
