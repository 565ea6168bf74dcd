"""Substring dedup against a window table; the automaton against plain search; edge rows."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grove.llm import queries, substring_dedup
from grove.llm.substring_dedup import SuffixAutomaton, first_labels, remove_repeats

SF = "/root/testdata/sf0.001"


def plain_version(rows, window=13, reference=()):
    """(n_words, n_removed, kept) per row."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for text in reference:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(w) - window + 1):
            first[tuple(w[i:i + window])] = float("-inf")
    for (key, _), w in zip(rows, split):
        for i in range(len(w) - window + 1):
            x = tuple(w[i:i + window])
            if key is not None and key < first.get(x, float("inf")):
                first[x] = key
    out = []
    for (key, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if key is not None and first[tuple(w[i:i + window])] < key:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, rows, reference=None, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ref = None if reference is None else spark.createDataFrame([(t,) for t in reference], "text string")
    got = remove_repeats(docs, reference=ref, **options).collect()
    want = plain_version(rows, options.get("window", 13), reference or ())
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == sorted(
        ((k, *x) for (k, _), x in zip(rows, want)), key=repr)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1, max_size=5), words, st.integers(1, 6))
def test_matching_statistics_equal_plain_search(reference, text, most):
    automaton = SuffixAutomaton()
    for label, ws in enumerate(reference):
        automaton.add(ws, label)

    def found(stretch):
        return [k for k, ws in enumerate(reference)
                if any(ws[i:i + len(stretch)] == stretch for i in range(len(ws) - len(stretch) + 1))]

    for end, (size, label) in enumerate(automaton.stream(text, most), 1):
        best = max((m for m in range(1, min(most, end) + 1) if found(text[end - m:end])), default=0)
        assert size == best
        if size == most:
            assert label == min(found(text[end - size:end]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=4, max_size=12), st.integers(0, 9)),
                min_size=1, max_size=8))
def test_first_labels_of_a_shard(shard):
    got = first_labels([(" ".join(ws).encode(), label) for ws, label in shard], 4)
    for (ws, _), firsts in zip(shard, got):
        assert firsts == [min(label for v, label in shard
                              if any(v[j:j + 4] == ws[i:i + 4] for j in range(len(v) - 3)))
                          for i in range(len(ws) - 3)]


def passages(seed, n_docs=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(9, 40))] for _ in range(12)]
    rows = []
    for key in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            part = rng.choice(shared)
            a = rng.randint(0, len(part) // 2)
            words += part[a:a + rng.randint(5, 40)]
        rows.append((rng.randint(-50, n_docs), " ".join(words)))
    return rows


def test_shared_passages(spark):
    rows = passages(1)
    check(spark, rows)
    check(spark, rows[:60], reference=[t for _, t in rows[60:]] + [None, "", "short"])
    check(spark, rows, window=8, gram=3)


def test_anchors_dealt_by_window(spark):
    rng = random.Random(3)
    line = " ".join(f"l{i}" for i in range(14))
    rows = [(k, f"x{rng.random()} y{k % 7} {line} z{k % 5} q{k % 3} " + " ".join(
        f"t{rng.random()}" for _ in range(9))) for k in range(300)]
    check(spark, rows, hot_segments=4)
    check(spark, passages(2), hot_segments=1)


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l m"),
        (6, "a b\tc d e\nf g h i j k l m n"), (6, "a b\tc d e\nf g h i j k l m n"), (6, "x a b c d e f g h i j k l m"),
        (None, "a b c d e f g h i j k l m"), (None, "a b c d e f g h i j k l m"), (7, "p " * 40_000), (8, "p " * 90 + "r"),
        (9, "A b c d e f g h i j k l m"), (10, "é ñ 中 🎉 <P> , . - _ ü ö ä ß"), (11, "0 é ñ 中 🎉 <P> , . - _ ü ö ä ß 1")]


def test_edge_rows(spark):
    check(spark, EDGE)
    check(spark, [])
    check(spark, EDGE, reference=[])


def test_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, "t", 5, 6), (2, text, "u", 7, 8)],
                                 "doc_id long, text string, _TEXT string, rid int, _rids int")
    rows = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert (rows[2]["_TEXT"], rows[2].rid, rows[2]["_rids"], rows[2].kept, rows[2].n_removed) == ("u", 7, 8, "", 20)
    assert rows[1].kept == text and rows[1].spans == []
    with pytest.raises(ValueError):
        remove_repeats(docs, gram=14)


def test_query_equals_the_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op11_substring_dedup(spark, SF).collect()}
    for (key, _), (n, gone, kept) in zip(rows, plain_version(rows)):
        assert tuple(got[key])[1:] == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.WINDOW == 13
