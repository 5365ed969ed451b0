import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from strata.llm.decontaminate import BYTES_A_BYTE, Hits, WindowSet, contamination, remove_contamination
from strata.llm.licenses import PHRASES, Automaton, compile_template, parse, scan_licenses, words_of
from tests.llm.helpers import rng, rows, table, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# --- licenses --------------------------------------------------------------


def test_markup():
    assert parse("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;match=1-2>> d") == [b"a", ("opt", [b"b", ("opt", [b"c"])]), ("var", 1, 2), b"d"]
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<what>>", "<<var;match=1-2>> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            compile_template("x", bad)


def test_automaton():
    a: Automaton = compile_template("x", "copyright <<var;match=1-3>> all <<beginOptional>>of the <<endOptional>>rights reserved")
    for text, n in (("Copyright 2020 Me. All rights reserved", 6), ("copyright x all of the rights reserved!", 7), ("copyright all rights reserved", 0), ("copyright a b c d all rights reserved", 0), ("copyright all all rights reserved", 5), ("copyright x all of rights reserved", 0)):
        assert a.match(words_of(text), 0) == n, text


def test_scan(spark):
    r = rng(2)
    texts = [None, "", "Under the MIT License", "under  the,MIT\nlicense under the mit license", "é under the mit licensed", "Apache License Version 2", "CC-BY/NC cc by nc", "x" * 50_000 + " Cc By Nc " + words(r, 30_000), "All Rights Reserved.", "Licensed under the GNU General Public License, either version 3", (2, "dup under the mit license"), (None, "cc by nc")]
    docs = table(spark, texts)
    got = scan_licenses(docs).collect()
    assert len(got) == len(texts)

    def brute(text):
        w = split(text)
        at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))

    want = sorted((((t[0], *brute(t[1])) if isinstance(t, tuple) else (k, *brute(t))) for k, t in enumerate(texts)), key=repr)
    assert rows(scan_licenses(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    by = {r.doc_id: r for r in got}
    assert by[8].labels == "all-rights-reserved" and by[9].labels == "gpl-3" and by[0].score == 0.0 and all(0 <= r.score <= 1 for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert scan_licenses(docs.limit(0)).count() == 0


# --- decontamination -------------------------------------------------------


def brute(text, items, k=10):
    w = split(text)
    hit, found = set(), set()
    for item, t in items:
        v = split(t)
        n = min(k, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def cases():
    r = rng(4)
    items = [(k, words(r, 14)) for k in (1, 2, 10, 100)] + [(5, "short Item é"), (6, ""), (7, None), (8, "one"), (2, words(r, 12))]
    a, b, c = items[0][1], items[1][1], items[2][1]
    texts = [None, "", a, a.upper().replace(" ", "; "), "pre " + a + " post " + b, " ".join(a.split()[:9]), " ".join(a.split()[3:]) + " " + c, a + " " + a, "a short item É short item é", "One", words(r, 20_000) + " " + c, (3, a), (None, b), a.split()[0] + " " + " ".join(["one"] * 5)]
    return texts, items


def test_contamination(spark):
    texts, items = cases()
    docs, bench = table(spark, texts), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    want = sorted(((t[0], *brute(t[1], items)) if isinstance(t, tuple) else (k, *brute(t, items)) for k, t in enumerate(texts)), key=repr)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(contamination(docs, bench), *names) == want
    assert rows(contamination(docs, bench, most_bytes=4000), *names) == want
    assert contamination(docs.limit(0), bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_removal(spark):
    texts, items = cases()
    docs, bench = table(spark, texts), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    out = remove_contamination(docs, bench)
    assert out.columns == docs.columns and contamination(out, bench).where("contaminated").count() == 0
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[0].text is None and kept[1].text == "" and kept[5].text == texts[5] and 2 not in kept and 7 not in kept
    assert kept[10].n_chars == len(kept[10].text) < len(texts[10]) and kept[10].text.startswith(texts[10][:1000])
    several = remove_contamination(docs, bench, most_bytes=4000)
    assert contamination(several, bench).where("contaminated").count() == 0


def test_removal_in_passes_is_removal_in_one(spark):
    texts, items = cases()
    r = rng(6)
    x, y, z = (words(r, 30, 10**6) for _ in range(3))
    items += [(20, x), (21, y), (22, " ".join(z.split()[:18])), (23, " ".join(z.split()[9:]))]
    texts += [x + " " + y + " " + words(r, 40, 10**6), "pre " * 60 + z + " post", x[: len(x) // 2] + " " + words(r, 100, 10**6) + ", " + z + "; " + words(r, 9)]
    texts.append(words(r, 30, 10**6) + " " + " ".join(x.split()[:5]) + " " + y + " " + " ".join(x.split()[5:12]) + " " + words(r, 30, 10**6))
    docs, bench = table(spark, texts), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    one = remove_contamination(docs, bench)
    assert len(texts) - 4 not in {d.doc_id for d in one.collect()}
    for most in (900, 4000):
        several = remove_contamination(docs, bench, most_bytes=most)
        assert several.columns == docs.columns and rows(several, *docs.columns) == rows(one, *docs.columns)


def test_sets_are_small_and_equal_windows_are_one(spark):
    r = rng(8)
    a = words(r, 3000, 10**6)
    ids, texts = [7, 9, 9, 3, 4], [a, a, a, "Two  words", None]
    s = WindowSet(np.array(ids), pa.array([t or "" for t in texts]), 10)
    text = sum(len(t or "") for t in texts)
    assert s.nbytes <= BYTES_A_BYTE * text and len(s.lengths[10][0]) == 2991 and set(s.lengths) == {2, 10}
    assert s.lengths[10][2].tolist() == list(range(0, 2 * 2992, 2)) and s.lengths[10][3][:4].tolist() == [7, 9, 7, 9]
    hits = Hits(pa.array(["x " + a, "", None, "TWO, words", a[:40]]))
    hits.add(s, s.bitmaps())
    assert {d: x.tolist() for d, x in hits.united().items()} == {0: [[1, 3001]], 3: [[0, 2]]} and hits.items == {0: {7, 9}, 3: {3}}


def test_giant_item_over_several_sets(spark):
    r = rng(9)
    item = words(r, 900, 10**6)
    docs = table(spark, [item, "a " + " ".join(item.split()[400:425]) + " b " * 99, words(r, 50)])
    bench = spark.createDataFrame([(1, item), (None, words(r, 20))], "item_id BIGINT, text STRING")
    one, several = (rows(contamination(docs, bench, most_bytes=m), "doc_id", "n_words", "n_hit", "n_items") for m in (1 << 26, 9000))
    assert one == several and [r[2] for r in one] == [900, 25, 0]


def test_a_column_named_like_the_length_stays(spark):
    a = words(rng(10), 12)
    docs = spark.createDataFrame([(1, "x " * 30 + a, "mine")], "doc_id BIGINT, text STRING, n_chars STRING")
    (row,) = remove_contamination(docs, spark.createDataFrame([(1, a)], "item_id BIGINT, text STRING")).collect()
    assert row.n_chars == "mine" and a not in row.text
