"""Periodic runs against a brute force over all periods; planted tails; edge rows."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grove.llm import periodic, queries
from grove.llm.common import WordIndex, offsets

SF = "/root/testdata/sf0.001"


def brute_runs(w, exponent=4, least=6):
    """Every (start, length, period), by start, then period."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least, exponent * q) and not any(
                    all(w[j] == w[j + p] for j in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def library_runs(lists, exponent=4, least=6):
    flat = WordIndex().numbers([x for ws in lists for x in ws])
    text, *cols = periodic.runs_of(flat, offsets([len(ws) for ws in lists]), exponent, least)
    out = [[] for _ in lists]
    for t, *run in zip(text.tolist(), *[c.tolist() for c in cols]):
        out[t].append(tuple(run))
    return out


blocks = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9),
                            st.integers(1, 12)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(blocks, min_size=1, max_size=4), st.sampled_from([(4, 6), (4, 1), (5, 6)]))
def test_runs_equal_brute_force(texts, limits):
    lists = [[b"%d" % x for unit, times in t for x in unit * times] for t in texts]
    assert library_runs(lists, *limits) == [brute_runs(ws, *limits) for ws in lists]


def test_long_periods_and_words_of_two_texts_stay_apart():
    rng = np.random.default_rng(5)
    unit = [b"%d" % x for x in rng.integers(0, 10 ** 6, 700)]
    lists = [unit * 5, unit[:300] + unit[:300], [b"a"] * 5, [b"a"] * 6, unit * 4 + [b"x"] + unit * 4]
    got = library_runs(lists)
    assert got == [[(0, 3500, 700)], [], [], [(0, 6, 1)], [(0, 2800, 700), (2801, 2800, 700)]]
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(3, np.int64), np.array([0, 3]), 3)


def test_wavelet_matrix_equals_sorting():
    rng = np.random.default_rng(1)
    values = rng.permutation(1000)
    w = periodic.WaveletMatrix(values)
    lo = rng.integers(0, 999, 300)
    hi = lo + rng.integers(1, 1000 - lo + 1)
    v = rng.integers(0, 1000, 300)
    below = [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, v)]
    assert w.below(lo, hi, v).tolist() == below
    k = rng.integers(0, hi - lo)
    assert w.select(lo, hi, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, k)]


def planted(key, words):
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(key, text):
    w = planted(key, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_periodic_runs(spark, SF).collect()
    assert len(rows) == len(texts)
    short = [r for r in rows if len(texts[r.doc_id].split()) < 1500]
    assert len(short) > 150 and any(r.n_runs for r in short)
    for r in short:
        assert tuple(r)[1:] == digest(r.doc_id, texts[r.doc_id]), r.doc_id


def test_edge_rows(spark, tmp_path):
    tenth = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 7), (4, "a " * 7), (None, "b\x0bb\tb b b b"),
            (5, "x y " * 60_000 + "z"), (6, "a b a b a b a b c c c c c c"), (tenth, None), (tenth, ""),
            (tenth, "one"), (tenth, "é ñ ü " * 9), (7, "é é é é " * 8)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, path).collect()]
    assert sorted((r for r in got if r[0] != 5), key=repr) == sorted(
        ((k, *digest(k, t)) for k, t in rows if k != 5), key=repr)
    (long,) = [r for r in got if r[0] == 5]
    assert long[1:6] == (1, 0, 120_000, 2, 60_000_000)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a a a a a a", "t", 5)], "doc_id long, text string, _TEXT string, runs int")
    out = periodic.find_runs(docs)
    r = out.first()
    assert (r["_TEXT"], r.collapsed, r.n_words) == ("t", "a", 6) and r.runs[0].asDict() == \
        {"start": 0, "length": 6, "period": 1}
    assert periodic.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, min_exponent=2)
