import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strata.llm.sharding import _splitters, shard_documents, write_shards
from strata.llm.tokens import END_ID, Reader, Writer, encode_key, read_tokens, tokenize_to_files, write_tokens
from strata.llm.topk import BitSlicedBlock, top_k
from tests.llm.helpers import rng, rows, table, words

# --- sharding --------------------------------------------------------------


def test_shards(spark):
    r = rng(1)
    hot = words(r, 40)
    texts = [words(r, r.randrange(1, 120)) for _ in range(1500)] + [hot] * 900 + [None, None, "", "z" * 9000] + [(5, "five"), (5, "five"), (None, "n")]
    got = shard_documents(table(spark, texts)).collect()
    assert len(got) == len(texts) and {x.law for x in got} == {"bytes"} and all(x.grown_shard is None for x in got)
    sizes, slots, groups = Counter(), defaultdict(list), defaultdict(Counter)
    for x in got:
        sizes[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
        groups[x.text_crc32][x.shard] += 1
    assert set(sizes) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 24
    assert max(abs(v - mean) for v in sizes.values()) < 10_000
    by = {x.doc_id: x for x in got}
    t = texts[3]
    assert (by[3]["size"], by[3].text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
    assert by[2400]["size"] == 8 and by[2400].text_crc32 is None
    assert len(groups[zlib.crc32(hot.encode())]) > 1 and len(groups[zlib.crc32(b"five")]) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_against_a_sorted_list(spark, seed):
    """The law on the driver: all records in key order, a group or record placed by its middle byte."""
    r = rng(seed)
    hot = words(r, 60)
    texts = [words(r, r.randrange(1, 90)) for _ in range(700)] + [hot] * 500 + ["twice"] * 3 + [None, None, "", "y" * 3000]
    docs = table(spark, texts)
    keyed = docs.selectExpr("doc_id", "coalesce(octet_length(text), 0) + 8 AS size", "xxhash64(text) AS k").collect()
    order = sorted((x.k, x.doc_id, x["size"]) for x in keyed)
    total = sum(x[2] for x in order)
    limit = max(total // 2400, max(x[2] for x in order))
    groups, at = {}, 0
    for k, _, size in order:
        first, held = groups.get(k, (at, 0))
        groups[k] = (first, held + size)
        at += size
    want, at, slots = [], 0, Counter()
    for k, i, size in order:
        first, held = groups[k]
        middle = 2 * first + held if held <= limit else 2 * at + size
        shard = min(23, middle * 24 // (2 * total))
        want.append((i, shard, slots[shard]))
        slots[shard] += 1
        at += size
    assert rows(shard_documents(docs), "doc_id", "shard", "slot") == sorted(want, key=repr)


def test_equal_texts_stay_together_at_every_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    split = shard_documents(docs).groupBy("text_crc32").agg({"shard": "max", "doc_id": "count"}).toDF("c", "a", "n")
    least = shard_documents(docs).groupBy("text_crc32").agg({"shard": "min"}).toDF("c", "b")
    assert split.join(least, "c").where("a <> b").count() == 0


def test_no_rows_and_few_rows(spark):
    docs = table(spark, ["a", "b", "b"])
    assert shard_documents(docs.limit(0)).count() == 0
    got = shard_documents(docs).collect()
    assert len(got) == 3 and all(0 <= x.shard < 24 for x in got)


def test_splitters_respect_groups():
    sample = sorted([(k, 0, 0) for k in range(50)] + [(7, t, 0) for t in range(100)])
    s = _splitters(sample, 10, 20)
    assert any(k == 7 and t >= 0 for k, t, _ in s) and all(k == 7 or t < 0 for k, t, _ in s)


def test_write_shards(spark, tmp_path):
    docs = table(spark, [f"text {k}" for k in range(100)])
    write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


# --- token files -----------------------------------------------------------

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_file_round_trip(tmp_path):
    path = str(tmp_path / "a.sst")
    r = rng(3)
    entries = [(None, [1, 2]), *((k, [r.randrange(60_000) for _ in range(r.randrange(3000))]) for k in sorted(r.sample(range(-(1 << 40), 1 << 40), 300)))]
    entries.insert(20, entries[20])
    with open(path, "wb") as f:
        w = Writer(f, 2)
        for k, v in entries:
            w.add(encode_key(k), struct.pack(f"<{len(v)}H", *v))
        w.close()
    reader = Reader(path)
    assert [(k, v.tolist()) for k, v in reader.scan()] == entries and reader.entries == len(entries) and len(reader.blocks) > 3
    assert all(reader.get(k)[0].tolist() == v for k, v in entries) and len(reader.get(entries[20][0])) == 2
    misses = [k for k in range(1, 4000) if reader.maybe(encode_key(k))]
    assert reader.get(3) == [] and len(misses) < 200
    with pytest.raises(ValueError):
        Writer(open(path, "rb"), 2).__class__.add(w, encode_key(-1 << 50), b"")
    data = bytearray(open(path, "rb").read())
    data[10] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(Reader(path).scan())


def test_tokens(spark, tmp_path):
    r = rng(6)
    texts = [words(r, 50) for _ in range(60)] + [None, "", "Don't STOP!! <|endoftext|> é ÉCOLE naïve x \x1c y 東京 1234", "a" * 5000, "long " * 50_000, (3, "again"), (3, "again"), (None, "no id"), (-7, "minus")]
    docs = table(spark, texts)
    got = sorted(tokenize_to_files(docs, TOKENIZER).collect(), key=lambda x: x.start)
    library = Tokenizer.from_file(TOKENIZER)
    at = 0
    keys = [(-1 << 63 if x.doc_id is None else x.doc_id) for x in got]
    assert keys == sorted(keys) and len(got) == len(texts)
    want = defaultdict(list)
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (k, t)
        ids = library.encode(t or "", add_special_tokens=False).ids + [END_ID]
        want[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for x in got:
        assert x.start == at
        at += x.n_tokens
        want[x.doc_id].remove((x.n_tokens, x.ids_crc32))
    written = write_tokens(docs, open(TOKENIZER, encoding="utf-8").read(), str(tmp_path / "f"), file_bytes=2000)
    assert len(written.files) > 2 and len(written.lookup(3)) == 3 and written.lookup(None) and written.lookup(10_000) == []
    assert rows(read_tokens(spark, written, with_ids=True), "doc_id", "start", "n_tokens", "ids_crc32") == rows(spark.createDataFrame([(x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in got], "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"), "doc_id", "start", "n_tokens", "ids_crc32")


def test_no_documents(spark):
    assert tokenize_to_files(table(spark, ["x"]).limit(0), TOKENIZER).count() == 0


# --- top k -----------------------------------------------------------------


def test_digits():
    for w in range(-300, 301):
        d = BitSlicedBlock.digits(w)
        assert sum((1 - 2 * s) << p for p, s in d) == w and all(b - a > 1 for (a, _), (b, _) in zip(d, d[1:], strict=False))


def test_block_against_brute_force():
    r = np.random.default_rng(0)
    for n, high in ((1, 5), (63, 3), (64, 2), (200, 2), (1000, 200)):
        x = r.integers(-high, high + 1, (n, 7))
        block = BitSlicedBlock(np.arange(n), np.arange(n), x)
        for own in range(min(n, 20)):
            s = x @ x[own]
            want = [j for j in np.lexsort((np.arange(n), -s)) if j != own][:5]
            assert sorted(block.top_rows(x[own], own, 5).tolist()) == sorted(want)


@pytest.mark.parametrize(("block", "query_block"), [(1 << 15, 4096), (16, 2)])
def test_top_k(spark, block, query_block):
    r = np.random.default_rng(1)
    vectors = [(k, r.normal(size=6).round(1).tolist()) for k in range(260)] + [(50, [1.0] * 6), (None, [1.0] * 6), (300, None), (301, [1.0, None, 0, 0, 0, 0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [9.0, 9.0]), (350, [])]
    df = spark.createDataFrame([(k, v and [None if x is None else float(x) for x in v] if v != [] else [], k, "x") for k, v in vectors], "vec_id BIGINT, embedding ARRAY<FLOAT>, row BIGINT, rank STRING")
    good = [(k, np.array([np.floor(256 * float(np.float32(x))) for x in v] + [0] * (6 - len(v)))) for k, v in vectors if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, (q, v) in enumerate(good):
        if q % 50 == 0:
            s = sorted((-int(v @ w), k) for j, (k, w) in enumerate(good) if j != i)[:5]
            want += [(q, n, k, -x) for n, (x, k) in enumerate(s, 1)]
    got = top_k(df, block=block, query_block=query_block)
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


@pytest.mark.parametrize("block", [1 << 15, 3])
def test_large_components_count_exactly(spark, block):
    vectors = [(0, [1e7, 1.0]), (50, [-3.0, 2.5]), (1, [1e7, -2.0]), (2, [2.0, 1e9]), (3, [-1e7, 0.5]), (4, [1e300, 1.0]), (5, [0.25, 0.5]), (100, [1e15, -1e15])]
    df = spark.createDataFrame(vectors, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    whole = {k: [int(np.floor(256 * x)) if abs(x) < 1e200 else int(x) * 256 for x in v] for k, v in vectors}
    clip = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    want = []
    for q in (0, 50, 100):
        s = sorted((-clip(sum(a * b for a, b in zip(whole[q], w, strict=True))), k) for k, w in whole.items() if k != q)[:5]
        want += [(q, n, k, -x) for n, (x, k) in enumerate(s, 1)]
    assert rows(top_k(df, block=block, query_block=2), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert top_k(df).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert top_k(one).count() == 0
