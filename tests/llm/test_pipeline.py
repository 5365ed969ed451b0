"""The pipeline against a plain version of each stage, and the registered queries."""

import re

import pyarrow as pa
import public_tokenizers
import sentencepiece

import __spark_entry__
import corpus_pipeline
from strata.llm import queries
from strata.llm.language import train_language_model
from strata.llm.toxicity import Scorer, _scores, train_toxicity_model
from tests.llm.helpers import rng, words
from tests.llm.test_near_duplicates import brute as brute_components
from tests.llm.test_near_duplicates import edited

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STEMS = {"en": ["the", "ing", "tion", "wh"], "de": ["der", "sch", "ung", "ße"]}


def tables(spark, path):
    r = rng(21)
    docs, labels = [], []
    items = [(k, words(r, 15, 10**6)) for k in range(5)]
    for k in range(160):
        lang = "de" if k % 3 == 0 else "en"
        t = " ".join("".join(r.choices(STEMS[lang], k=r.randrange(2, 6))) for _ in range(60))
        toxic = k % 4 == 0
        if toxic:
            w = t.split()
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "worthless", "moron"]))
            t = " ".join(w)
        docs.append((k, t, lang, "s", len(t)))
        labels.append((k, 1, int(toxic)))
    base = docs[1][1]
    extra = [base, base, edited(r, base, 1), docs[2][1] + " " + items[0][1] + " end", items[1][1], "12 34", "", None, "the ingtion " * 300 + items[2][1]]
    docs += [(200 + k, t, "en" if k < 5 else None, "s", None if t is None else len(t)) for k, t in enumerate(extra)]
    docs.append((None, docs[5][1], None, None, None))
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(f"{path}/benchmark.parquet")
    return items


def without(text, items):
    """text without item windows, None if it is mostly such."""
    raw = (text or "").encode()
    low = raw.lower().decode()
    found = list(WORD.finditer(low))
    w = [m.group() for m in found]
    hit = set()
    for _, t in items:
        v = WORD.findall(t.lower())
        for j in range(len(v) - 9):
            hit |= {q for i in range(len(w) - 9) if w[i : i + 10] == v[j : j + 10] for q in range(i, i + 10)}
    if len(hit) > 0.5 * len(w):
        return None, True
    out, at, k = "", 0, 0
    while k < len(w):
        if k in hit:
            out += text[at : found[k].start()]
            while k in hit:
                at = found[k].end()
                k += 1
        else:
            k += 1
    return (text if text is None else out + text[at:]), False


def test_against_plain_version(spark, tmp_path):
    path = str(tmp_path)
    items = tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    model = train_language_model(docs)
    langs, scores = model.predict(pa.array([t for _, t in kept], pa.string()))
    kept = [d for d, lang, s in zip(kept, langs, scores, strict=True) if lang != "und" and s >= 0.4]
    frame = spark.createDataFrame(kept, "doc_id BIGINT, text STRING")
    tox = train_toxicity_model(frame, spark.read.parquet(f"{path}/labels.parquet"))
    kept = [d for d, s in zip(kept, _scores(tox, Scorer(tox.lexicon), [t for _, t in kept]), strict=True) if s < 0.3]
    first = {i for i, _, c in brute_components(kept) if i == c}
    kept = [d for d in kept if d[0] is None or d[0] in first]
    cleaned = [(i, *without(t, items)) for i, t in kept]
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    want = sorted(((i, library.encode(t or "")) for i, t, gone in cleaned if not gone), key=repr)
    got = sorted(((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, path).collect()), key=repr)
    assert got == want
    ids = {i for i, _ in got}
    assert 1 in ids and not ids & {0, 4, 8, 200, 201, 202, 204, 205, 206, 207} and {203, 208} <= ids


def test_filters_without_training_rows_drop_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the thing", None), (2, "die Sache", None), (3, "", None), (4, None, None), (None, "12", None)], "doc_id BIGINT, text STRING, lang STRING")
    want = sorted(map(tuple, docs.collect()), key=repr)
    for name, rows in (("none", []), ("others", [(77, 1), (78, 0)]), ("toxic", [(k, 1) for k in range(1, 4)])):
        spark.createDataFrame(rows, "doc_id BIGINT, toxic INT").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert sorted(map(tuple, corpus_pipeline.toxicity(spark, docs, f"{tmp_path}/{name}").collect()), key=repr) == want
    assert sorted(map(tuple, corpus_pipeline.language(spark, docs, str(tmp_path)).collect()), key=repr) == want


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered():
    found = __spark_entry__.queries()
    assert {int(q[2:].split("_")[0]) for q in queries.queries()} == set(range(1, 11))
    assert set(queries.queries()) | {"pipeline"} <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)
