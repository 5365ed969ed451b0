import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm.pieces import EDGE, SPACE, Lattice, Spelling, cut_states, decode_pieces, encode_pieces, multiply, normalise, piece_bytes, round_trip
from tests.llm.helpers import rng, rows, table, words

with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
    MODEL = f.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
LATTICE = Lattice(MODEL)
SPELLING = Spelling(piece_bytes(LIBRARY))

parts = st.sampled_from(["a", "th", "ing", "The", " ", "  ", "     ", "\n", "\t", "é", "ß", "中", "😀", "1", "22", "....", "--", SPACE, "\x00", "er", "tion"])
texts = st.lists(parts, max_size=40).map("".join)


def ids_of(data):
    return np.frombuffer(data, "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(texts)
def test_words_equal_the_library(text):
    ids = ids_of(LATTICE.run(normalise(text)))
    assert ids == ids_of(LATTICE.whole([text])[0]) == LIBRARY.encode(text)
    flat = np.array(ids * 2, np.int64)
    assert SPELLING.texts(flat, np.array([0, len(ids), len(ids), len(flat)])).to_pylist() == [text.replace(SPACE, " "), "", text.replace(SPACE, " ")]
    assert LIBRARY.decode(ids) == text.replace(SPACE, " ")


def chunks(text, size):
    t, reach = normalise(text), LATTICE.longest + 1
    cuts = [*range(0, max(1, len(t) - reach), size), len(t)]
    return [(t[max(0, a - reach) : b + reach], a - max(0, a - reach), b - max(0, a - reach)) for a, b in zip(cuts, cuts[1:], strict=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(parts, min_size=20, max_size=200).map("".join), st.integers(20, 90), st.booleans())
def test_chunks_equal_the_library(text, size, spaceless):
    text = text.replace(" ", "").replace(SPACE, "") if spaceless else text
    if not text:
        return
    cut = chunks(text, size)
    matrices = [LATTICE.transfer(t, a, b, k == 0, k == len(cut) - 1) for k, (t, a, b) in enumerate(cut)]
    states = cut_states(matrices, EDGE, EDGE)
    got = b"".join(LATTICE.between(t, a, b, x, y) for (t, a, b), x, y in zip(cut, states, states[1:], strict=False))
    assert ids_of(got) == LIBRARY.encode(text)
    left = matrices[0]
    for m in matrices[1:]:
        left = multiply(left, m)
    right = matrices[-1]
    for m in matrices[-2::-1]:
        right = multiply(m, right)
    assert left == right and list(left) == [EDGE] and left[EDGE] == {EDGE: 0.0}


def documents(spark):
    r = rng(2)
    long = words(r, 900) + "  \n  " + "x" * 700 + "中文" * 300 + " " + words(r, 300)
    return table(spark, [words(r, 40), None, "", " ", long, long + " tail", (4, "again"), (None, "no id"), f"a{SPACE}b", "y" * 3000])


@pytest.mark.parametrize("chunk", [1 << 16, 500, 64])
def test_documents(spark, chunk):
    docs = documents(spark)
    got = rows(encode_pieces(docs, MODEL, chunk=chunk), "doc_id", "ids")
    want = sorted(((r.doc_id, LIBRARY.encode(r.text or "")) for r in docs.collect()), key=repr)
    assert got == want
    trip = round_trip(docs, MODEL, chunk=chunk)
    assert rows(trip, "doc_id", "ids") == want and all(r.restored == (SPACE not in r.text and r.ids != LIBRARY.encode(f"a{SPACE}b")) for r in trip.collect())


def test_decoding(spark):
    docs = documents(spark)
    back = decode_pieces(encode_pieces(docs, MODEL), MODEL)
    assert rows(back, "doc_id", "text") == sorted(((r.doc_id, (r.text or "").replace(SPACE, " ")) for r in docs.collect()), key=repr)
    assert encode_pieces(docs.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("chunk", [1 << 16, 64])
def test_round_trip(spark, chunk):
    texts = ["a b", None, "", f"a{SPACE}b", SPACE, "x " * 100 + SPACE + " y" * 100, "x " * 200 + "z", (None, "中 😀"), (0, "a b")]
    docs = table(spark, texts)
    got = rows(round_trip(docs, MODEL, chunk=chunk), "doc_id", "ids", "text", "restored")
    own = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert got == sorted(((i, LIBRARY.encode(t), t.replace(SPACE, " "), SPACE not in t) for i, t in own), key=repr)


def test_query_gives_ids_and_text(spark, tmp_path):
    from strata.llm.queries import op3_sentencepiece

    table(spark, ["a b", f"a{SPACE}b"]).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(op3_sentencepiece(spark, str(tmp_path)), "doc_id", "ids", "text", "restored") == [(0, LIBRARY.encode("a b"), "a b", True), (1, LIBRARY.encode(f"a{SPACE}b"), "a b", False)]


def test_ids_that_spell_no_utf8():
    e = [LATTICE.byte_ids[b] for b in "é".encode()]
    a = LATTICE.ids["a"]
    ids = np.array([e[0], e[1], a, *e, e[0]])
    assert SPELLING.texts(ids, np.array([0, 1, 3, 5, 6])).to_pylist() == ["\ufffd", "\ufffda", "é", "\ufffd"]


def test_caches_are_bounded_and_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(Lattice, "WORD_BYTES", 4000)
    monkeypatch.setattr(Lattice, "TAIL_BYTES", 2000)
    monkeypatch.setattr(Lattice, "PAIRS", 5)
    small, r = Lattice(MODEL), rng(3)
    for _ in range(30):
        text = "\n".join(words(r, 20).replace("w", r.choice(["The", "x.", "é"])) for _ in range(3))
        assert ids_of(small.whole([text])[0]) == LIBRARY.encode(text)
    assert max(len(small.words), len(small.words.old), len(small.tails)) < 25


def test_many_texts_at_once_equal_the_library(monkeypatch):
    monkeypatch.setattr(Lattice, "TOGETHER", 300)
    r = rng(7)
    long_words = ["ab" * 100, "x" * 127, "y" * 128, "ÿ中" * 80, "fooBar," * 30, "..." * 50, SPACE * 3 + "a", ""]
    made = [" ".join(r.choice([*long_words, *(w.replace("w", r.choice(["The", "é!", "naïve-"])) for w in words(r, 30))]) for _ in range(r.randrange(60))) for _ in range(40)]
    assert [ids_of(x) for x in LATTICE.whole(made)] == LIBRARY.encode(made)
    assert LATTICE.whole([]) == [] and LATTICE.whole(["", "\x00"])[0] == b""


def test_pairs_of_pieces_stay_apart_as_merging_says():
    r = rng(8)
    plain = [k for p, k in LATTICE.ids.items() if LATTICE.merged(p) == [p]]
    a, b = (np.array([r.choice(plain) for _ in range(20_000)]) for _ in range(2))
    # one piece cut in two gives pairs that merge across
    halves = [(LATTICE.table.get(p[:e], -1), LATTICE.table.get(p[e:], -1)) for p in map(LATTICE.pieces.__getitem__, plain[::7]) for e in range(1, len(p))]
    cut_pairs = np.array([h for h in halves if min(h) >= 0])
    a, b = np.concatenate([a, cut_pairs[:, 0]]), np.concatenate([b, cut_pairs[:, 1]])
    want = [LATTICE.merged(LATTICE.pieces[x] + LATTICE.pieces[y]) == [LATTICE.pieces[x], LATTICE.pieces[y]] for x, y in zip(a, b, strict=True)]
    assert LATTICE.merges.apart(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_decoding_replaces_a_column_and_keeps_nulls(spark):
    enc = spark.createDataFrame([(1, LIBRARY.encode("a b"), "old"), (2, None, "old"), (3, [], "old")], "n BIGINT, ids ARRAY<INT>, text STRING")
    back = decode_pieces(enc, MODEL)
    assert back.columns == ["n", "ids", "text"] and rows(back, "n", "text") == [(1, "a b"), (2, None), (3, "")]
