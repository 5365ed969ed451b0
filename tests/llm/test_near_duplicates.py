import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import near_duplicates as N
from tests.llm.helpers import rng, rows, table, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, similarity=85, k=4):
    """docs: [(id, text)] -> sorted (id, n, component)."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for d, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                index[x].append(d)
    seen = set()
    for ds in index.values():
        for a in ds:
            for b in ds:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if 100 * len(x & y) >= similarity * len(x | y):
                        p, q = find(sets[a][0]), find(sets[b][0])
                        up[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def check(spark, docs, **options):
    got = rows(N.near_duplicates(table(spark, docs), **options), "doc_id", "n_shingles", "component_id")
    assert got == brute(docs, options.get("similarity", 85), options.get("shingle", 4))


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_sets():
    r = rng(0)
    texts = [None, "", "one", "one two three", "A b C d", "a a a a a a", words(r, 500, 5), "é x y z w", "x\ty\nz\x0bw v"]
    s, offsets = N.doc_sets(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(shingles(t)) for t in texts]
    for a, b in zip(offsets, offsets[1:], strict=False):
        assert (np.diff(s[a:b].astype(object)) > 0).all() if b - a > 1 else True


def test_sets_after_texts_without_words():
    a, b = "a b c d e f g h i j", words(rng(3), 40)
    alone = N.doc_sets(pa.array([a, b]))[0].tolist()
    texts = [None, a, b, "", a, " \n\t ", a, None, "", " ", a, "x y", b, None, a, ""]
    s, offsets = N.doc_sets(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(shingles(t)) for t in texts]
    n = len(shingles(a))
    for t, lo, hi in zip(texts, offsets, offsets[1:], strict=False):
        if t in (a, b):
            assert s[lo:hi].tolist() == (alone[:n] if t == a else alone[n:])


def test_small_cases(spark):
    a = "a b c d e f g h"
    check(spark, [(0, None), (1, ""), (2, "  \n"), (3, "one two"), (4, "ONE  two"), (5, "two one"), (6, a), (7, a.upper()), (8, a + " i"), (None, a), (None, None), (6, a), (9, "x"), (10, "x"), (11, a + " i j")])
    check(spark, [])


def test_edges_of_similarity(spark):
    base = [f"w{k}" for k in range(103)]
    docs = [(0, " ".join(base))]
    for k in range(1, 30):
        docs.append((k, " ".join(base[: 103 - k])))
    for k in range(30, 40):
        docs.append((k, " ".join(base[: 103 - (k - 30)] + [f"x{k}{j}" for j in range(k - 30)])))
    check(spark, docs[:1] + docs[16:19] + docs[30:])
    check(spark, docs)


def test_clusters_and_passages(spark):
    r = rng(7)
    docs, passage = [], words(r, 60, 10**6)
    for c in range(6):
        base = words(r, r.randrange(30, 260), 10**6)
        for _ in range(r.choice([2, 3, 12, 40])):
            docs.append(edited(r, base, r.randrange(0, 9)))
    docs += [words(r, 50, 10**6) + " " + passage + " " + words(r, 80, 10**6) for _ in range(30)]
    docs += [passage + " " + words(r, r.randrange(0, 14), 10**6) for _ in range(25)]
    docs += [words(r, 120, 10**6) for _ in range(40)] + [docs[0]] * 30
    r.shuffle(docs)
    check(spark, list(enumerate(docs)))


@pytest.mark.parametrize(("bits", "bucket", "stars", "block"), [(2, 2, 1, 1024), (2, 1, 0, 3), (64, 32, 2, 1024)])
def test_every_way_gives_the_same(spark, monkeypatch, bits, bucket, stars, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "FREQUENT_BITS", bits)
    monkeypatch.setattr(N, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(N, "STAR_ROUNDS", stars)
    r = rng(11)
    docs = []
    for c in range(4):
        base = words(r, r.randrange(20, 200), 10**6)
        docs += [edited(r, base, r.randrange(0, 10)) for _ in range(15)]
    check(spark, list(enumerate(docs)))


def test_boilerplate_makes_no_candidates(spark, monkeypatch):
    """Texts of shared paragraphs that do not link: what is handed on for exact comparison grows no faster than the texts."""
    handed = []
    verified = N._Join.verified

    def counted(self, pairs, nodes):
        handed[-1] += pairs.count()
        return verified(self, pairs, nodes)

    monkeypatch.setattr(N._Join, "verified", counted)
    r = rng(17)
    paragraphs = [words(r, 25, 10**6) for _ in range(60)]
    for n in (120, 240):
        docs = list(enumerate(" ".join(r.sample(paragraphs, 40)) for _ in range(n)))
        handed.append(0)
        assert N.near_duplicates(table(spark, docs)).where("component_id <> doc_id").count() == 0
    assert handed[0] <= 120 and handed[1] <= 240, handed


def test_bands_and_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL_BUCKET", 1)
    monkeypatch.setattr(N, "STAR_ROUNDS", 0)
    monkeypatch.setattr(N, "BLOCK", 5)
    r = rng(19)
    paragraphs = [words(r, 12, 10**6) for _ in range(12)]
    docs = [" ".join(r.sample(paragraphs, r.randrange(6, 12))) for _ in range(60)]
    docs += [edited(r, d, r.randrange(3)) for d in docs[:25]]
    check(spark, list(enumerate(docs)))


def test_other_parameters(spark):
    r = rng(13)
    base = words(r, 80, 10**6)
    docs = list(enumerate([edited(r, base, k) for k in range(12)]))
    check(spark, docs, similarity=60, shingle=2)


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_chains(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW_LINKS", few)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.comp for r in N.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_representatives(spark):
    docs = [(3, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "a b c d e"), (5, None), (6, None), (1, "a b c d e")]
    out = N.keep_representatives(table(spark, docs))
    assert out.columns == table(spark, docs).columns and rows(out, "doc_id") == [(1,), (5,), (6,), (None,), (None,)]


def test_representatives_with_clashing_names(spark):
    names = ["_rank", "_first", "rank", "id", "t", "doc", "row", "comp", "node", "own", "first", "hash"]
    docs = spark.createDataFrame([(i, "a b c d e", *range(len(names))) for i in (2, 1)], ["doc_id", "text", *names])
    out = N.keep_representatives(docs)
    assert out.schema == docs.schema and [tuple(r) for r in out.collect()] == [(1, "a b c d e", *range(len(names)))]


def test_representatives_of_repeated_ids(spark):
    a, b, c = "a b c d e", "f g h i j k", "l m n o p q"
    for x, y in ((a, b), (b, a)):
        docs = [(1, x), (2, x), (2, y), (2, y), (3, c), (3, c + " r s t u v w"), (4, None), (4, x), (4, c), (5, None), (5, None), (6, ""), (None, x)]
        want = [(1, x), (2, y), (3, c), (3, c + " r s t u v w"), (4, None), (5, None), (6, ""), (None, x)]
        assert rows(N.keep_representatives(table(spark, docs)), "doc_id", "text") == sorted(want, key=repr)
