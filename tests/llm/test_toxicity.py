import numpy as np
import pytest

from strata.llm.toxicity import Lexicon, Scorer, drop_toxic, learn_lexicon, score_toxicity, train_toxicity_model
from tests.llm.helpers import held_out, rng, table, words


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_automaton_finds_what_brute_force_finds():
    lexicon = Lexicon({"stupid": 1.0, "worthless": 2.0, "scum": 1.5, "vile*": 0.5, "abject*": 0.5})
    r = rng(3)
    for _ in range(4000):
        base = r.choice(["stupid", "worthless", "scum", "vileness", "vile", "abjection"])
        w = list(base)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = r.choice(["", "x", "s"])
        w = "".join(w)
        options = [lexicon.terms[t] * 0.6 ** distance(w, t) for t in ("stupid", "worthless", "scum") if w and distance(w, t) <= Lexicon.edits(t)]
        options += [0.5 * 0.6 ** distance(w[:k], t) for t in ("vile", "abject") for k in range(1, len(w) + 1) if distance(w[:k], t) <= Lexicon.edits(t)]
        got = lexicon.find(w)
        assert (got is None) == (not options) and (got is None or got[1] == pytest.approx(max(options))), w


def test_context():
    scorer = Scorer(Lexicon({"idiot": 1.0}))
    direct, quoted = scorer.NAMES.index("direct"), scorer.NAMES.index("quoted")
    plain, marks, told, none = (scorer.features(t) for t in ("you idiot", 'he wrote a "real idiot" there', "she called him an idiot", ""))
    assert plain[direct] > 0 and plain[quoted] == 0
    assert marks[direct] == told[direct] == 0 and marks[quoted] > 0 and told[quoted] > 0
    assert set(none) == {0.0} and scorer.features("y0u idi0t")[direct] > 0


def test_quotations_of_any_length_and_over_lines():
    scorer = Scorer(Lexicon({"idiot": 1.0}))
    direct, quoted = scorer.NAMES.index("direct"), scorer.NAMES.index("quoted")
    long = "word " * 400
    for text in (f'" {long} idiot {long} "', f"« {long}\n\nidiot »", "„so\nidiot“", "“an ‹odd› \"idiot” x", 'one " mark\n\nthen "idiot" said'):
        f = scorer.features(text)
        assert f[direct] == 0 and f[quoted] > 0, text
    for text in ('"a" idiot "b"', '5" wide\n\nidiot "', "idiot", "„a“ idiot"):
        f = scorer.features(text)
        assert f[direct] > 0 and f[quoted] == 0, text


def planted(spark):
    """Toxic texts use four insults; as many clean texts quote them. Held-out toxic texts have them misspelt only."""
    r = rng(31)
    bad = ["imbecile", "worthless", "disgusting", "pathetic"]
    texts, toxic, kind = [], [], []
    for k in range(400):
        t = words(r, 50).split()
        mode = ("toxic", "quote", "clean", "clean")[k % 4]
        for _ in range(4 if mode != "clean" else 0):
            w = r.choice(bad)
            if mode == "toxic" and held_out(k):
                j = r.randrange(1, len(w) - 1)
                w = w[:j] + r.choice(["", "x", w[j] * 2]) + w[j + 1 :]
            t.insert(r.randrange(1, len(t)), w if mode == "toxic" else f'"a {w} thing"')
        texts.append(" ".join(t))
        toxic.append(int(mode == "toxic"))
        kind.append(mode)
    labels = spark.createDataFrame([(k, 1, x) for k, x in enumerate(toxic)], "doc_id BIGINT, quality INT, toxic INT")
    return table(spark, texts), labels, kind


@pytest.mark.parametrize("off", ["", "edits", "context"])
def test_edits_and_context_decide(spark, monkeypatch, off):
    from strata.llm import toxicity as T

    docs, labels, kind = planted(spark)
    model = train_toxicity_model(docs, labels)
    own = docs.collect()
    if off == "edits":
        monkeypatch.setattr(Lexicon, "edits", staticmethod(lambda word: 0))
        model.lexicon = Lexicon(model.lexicon.terms)
    if off == "context":
        monkeypatch.setattr(T, "quoted_spans", lambda text: [])
    p = T._scores(model, Scorer(model.lexicon), [r.text for r in own])
    caught = np.mean([p[i] >= 0.3 for i, r in enumerate(own) if held_out(r.doc_id) and kind[r.doc_id] == "toxic"])
    blamed = np.mean([p[i] >= 0.3 for i, r in enumerate(own) if held_out(r.doc_id) and kind[r.doc_id] == "quote"])
    if off == "edits":
        assert caught < 0.1 and blamed < 0.1
    elif off == "context":
        assert caught > 0.9 and blamed > 0.9
    else:
        assert caught > 0.9 and blamed < 0.1


def corpus(spark):
    r = rng(5)
    bad = ["idiot", "worthless", "moron", "pathetic"]
    texts, toxic = [], []
    for k in range(300):
        t = words(r, 60).split()
        if k % 5 == 0:
            for _ in range(4):
                t.insert(r.randrange(len(t)), r.choice(bad))
        texts.append(" ".join(t))
        toxic.append(int(k % 5 == 0))
    labels = spark.createDataFrame([(k, 1, x) for k, x in enumerate(toxic)] + [(None, 0, 1), (7, None, None)], "doc_id BIGINT, quality INT, toxic INT")
    return texts, toxic, labels


def test_held_out(spark):
    texts, toxic, labels = corpus(spark)
    extra = [(800, None), (801, ""), (802, "an idi0t and a w0rthless mor0n, patheticc " + words(rng(9), 30)), (803, words(rng(1), 60_000)), (None, "idiot moron"), (5, texts[5])]
    docs = table(spark, texts + extra)
    model = train_toxicity_model(docs, labels)
    assert {"idiot", "worthless", "moron", "pathetic"} <= set(model.lexicon.terms)
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(docs.collect()) and all(r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in got)
    assert all(r.predicted == toxic[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 300)
    by = {r.doc_id: r.predicted for r in got}
    assert (by[800], by[801], by[802], by[803], by[None]) == (0, 0, 1, 0, 1)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_are_not_used(spark):
    texts, toxic, labels = corpus(spark)
    other = spark.createDataFrame([(k, 1 - x if held_out(k) else x) for k, x in enumerate(toxic)], "doc_id BIGINT, toxic INT")
    a, b = (train_toxicity_model(table(spark, texts), x) for x in (labels, other))
    assert a.lexicon.terms == b.lexicon.terms and np.array_equal(a.weights, b.weights)


def test_no_labels(spark):
    docs = table(spark, ["a", None])
    empty = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    assert [r.score for r in score_toxicity(docs, train_toxicity_model(docs, empty)).collect()] == [0.5, 0.5]
    assert score_toxicity(docs.limit(0), train_toxicity_model(docs.limit(0), empty)).count() == 0


def test_a_rare_term_is_found_at_any_size_and_copies_fill_no_lexicon(spark):
    r = rng(8)
    clean = [(words(r, 40), 0) for _ in range(1200)]
    toxic = [f"{words(r, 20)} {'achlichch' if k < 7 else 'moron'} {words(r, 20)}" for k in range(800)]
    copied = words(r, 30) + " onlyhere " + words(r, 30)
    for toxics in (toxic, toxic[:7] + toxic[400:]):
        sample = clean + [(t, 1) for t in toxics] + [(copied, 1)] * 300
        terms = learn_lexicon(spark.createDataFrame(sample, "text STRING, label INT").repartition(4)).terms
        assert any("achlichch".startswith(t.rstrip("*")) for t in terms) and not any("onlyhere".startswith(t.rstrip("*")) for t in terms)
