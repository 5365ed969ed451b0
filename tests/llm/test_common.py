import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import common as C

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é\n.\t中_", max_size=12)), max_size=8)


def lowered(column):
    raw, offsets = C.bytes_of(column)
    return C.LOWER[raw], offsets


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words(values):
    data, offsets = lowered(pa.array(values, pa.string()))
    for table, pattern in ((C.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (C.NONSPACE, r"[^\x20\x09-\x0D]+")):
        starts, ends, first = C.word_spans(data, offsets, table)
        got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first, first[1:], strict=False)]
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        assert got == [re.findall(pattern, (v or "").translate(lower)) for v in values]


def test_word_hashes_depend_on_words_only():
    a, b = "x" * 300_000, "y" * 5
    for text in (f"{b} {a} {b}", f"{a} {b} {a}"):
        data = np.frombuffer(text.encode(), np.uint8)
        s, e, _ = C.word_spans(data, np.array([0, len(data)]), C.ALNUM)
        h = C.word_hashes(data, s, e)
        assert h[0] == h[2] != h[1]
    data = np.frombuffer(("w " * 400_000).encode(), np.uint8)
    s, e, _ = C.word_spans(data, np.array([0, len(data)]), C.ALNUM)
    assert len(np.unique(C.word_hashes(data, s, e))) == 1


def test_window_hashes():
    h = np.arange(6, dtype=np.uint64)
    assert len(C.window_hashes(h, 4)) == 3 and len(C.window_hashes(h, 7)) == 0
    assert C.window_hashes(h, 4)[1] == C.window_hashes(h[1:], 4)[0]


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_pydict({"i": list(range(6)), "text": ["a" * 10, None, "b" * 100, "", "c", "d" * 5]})
    parts = list(C.slices(iter([batch, batch.slice(0, 0)]), "text", 12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6)) and len(parts) >= 3


def test_slices_bound_rows():
    batch = pa.RecordBatch.from_pydict({"text": [""] * 10_001})
    assert [p.num_rows for p in C.slices(iter([batch]), "text")] == [4096, 4096, 1809]


def test_no_local_folder_on_a_cluster():
    class Cluster:
        master = "local-cluster[2,1,1024]"

        class conf:
            get = staticmethod(lambda key, other: other)

    Cluster.sparkContext = Cluster
    Cluster.getConf = lambda: Cluster.conf_
    Cluster.conf_ = type("C", (), {"get": staticmethod(lambda key: None)})
    Cluster._jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})
    with pytest.raises(ValueError, match="checkpoint"):
        C.shared_dir(Cluster)


def test_logistic():
    x = np.random.default_rng(1).normal(size=(500, 3))
    y = (x[:, 0] * 2 - x[:, 1] + 0.3 > 0).astype(float)
    p = C.predict_logistic(x, C.fit_logistic(x, y))
    assert ((p > 0.5) == y).mean() > 0.97
    assert C.predict_logistic(np.zeros((1, 3)), C.fit_logistic(np.zeros((0, 3)), np.zeros(0)))[0] == 0.5


def test_sample(spark):
    from tests.llm.helpers import held_out, table

    docs = table(spark, [f"t{k}" for k in range(100)] + [(3, "again"), (None, "n")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(5, None), (None, 1)], "doc_id BIGINT, toxic INT")
    got = C.labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(got) == len({r["_id"] for r in got}) == 10 and not any(held_out(r["_id"]) for r in got)
    with pytest.raises(Exception):  # noqa: B017
        C.labelled_sample(docs, labels, "nope", 10).collect()
