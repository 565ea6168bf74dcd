"""Fill-in-the-middle against a plain version; edge rows; sentinels."""

import hashlib

import pytest
from pyspark.sql import functions as F

from grove.llm import fim, queries

SF = "/root/testdata/sf0.001"


def plain_version(key, text, unit="char", markers=fim.MARKERS, seed=1):
    x = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    text = text or ""
    units = list(text) if unit == "char" else text.splitlines(keepends=True)
    n = len(units)
    if not n or any(m in text for m in markers) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    p, s, m = markers
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid


EDGE = [(1, None), (2, ""), (3, "a"), (4, "é中🎉" * 5), (5, "has <M> inside"), (6, "< P><"),
        (7, "x<P" * 40 + "<S"), (8, "<\n<S\n" * 30), (9, "word né " * 400_000), (10, "\n\n"),
        (None, "a text without a key"), (11, "twice"), (11, "twice"), (12, "line\n" * 700_000)]


@pytest.mark.parametrize("unit", fim.UNITS)
@pytest.mark.parametrize("markers", [fim.MARKERS, ("\x01|", "(?", "é")])
def test_edge_rows_equal_the_plain_version(spark, unit, markers):
    docs = spark.createDataFrame([(k, t, i, 3.5) for i, (k, t) in enumerate(EDGE)],
                                 "doc_id long, text string, _text int, n double")
    out = fim.fill_in_middle(docs, unit=unit, markers=markers)
    got = {r["_text"]: r for r in out.withColumn("back", fim.restored(markers=markers)).collect()}
    assert set(out.columns) == {"doc_id", "text", "_text", "n", "form", "prefix_chars",
                                "middle_chars", "output"}
    for i, (key, text) in enumerate(EDGE):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == \
            plain_version(key, text, unit, markers), i
        assert r.back == (text or "") and r.text == text


def test_rates_seed_and_layout(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"),
                                    F.repeat(F.lit("ab c"), 5).alias("text"))
    share = dict(fim.fill_in_middle(docs, fim_rate=0.5, spm_rate=0.5).groupBy("form").count().collect())
    assert 1350 < share["plain"] < 1650 and 600 < share["spm"] < 900
    assert set(fim.fill_in_middle(docs, fim_rate=0.0).select("form").distinct().toPandas().form) == {"plain"}
    a = fim.fill_in_middle(docs.repartition(7)).orderBy("doc_id").collect()
    assert a == fim.fill_in_middle(docs.coalesce(1)).orderBy("doc_id").collect()
    assert a != fim.fill_in_middle(docs, seed=2).orderBy("doc_id").collect()


def test_empty_table_and_bad_parameters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(docs).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("ab", "bc", "x"), ("abc", "b", "x"),
                ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, markers=bad)
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="word")
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, fim_rate=1.5)


def test_query_covers_all_documents(spark):
    rows = queries.op12_fill_in_middle(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, form, pre, mid, out = plain_version(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, pre, mid)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
