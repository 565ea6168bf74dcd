"""Operators of grove.llm against brute force, exact round trips and edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grove.llm import (bpe, common, decontam, fertility, html_density, langid, license_scan,
                       ngram_join, packed_ids, pu_quality, queries, url_trie)

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (5, "ONE"), (6, "a b c d " * 9000),
        (7, "<script>#*| 中文 ñ é"), (None, "a text without a key"), (8, "cc by CC-BY cc by")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(k, t, "en", "n", 1, True) for k, t in EDGE],
                                 "doc_id long, text string, lang string, n_words string, "
                                 "score int, kept boolean")


def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_components(rows, n, percent):
    sets = {}
    for key, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        m = min(n, len(w))
        sets[key] = {tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(list)
    for k in sorted(sets):
        common_ = defaultdict(int)
        for g in sets[k]:
            for j in seen[g]:
                common_[j] += 1
        for j, o in common_.items():
            if 100 * o >= percent * (len(sets[k]) + len(sets[j]) - o):
                a, b = sorted((find(k), find(j)))
                root[b] = a
        for g in sets[k]:
            seen[g].append(k)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, n, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ngram_join.jaccard_components(docs, n=n, percent=percent).collect()
    want = brute_components(texts(spark).items(), n, percent)
    assert {r[0]: (r[1], r[2]) for r in got} == want and len(got) == len(want)


def test_ngram_join_near_copies(spark):
    """One text with one or two words changed at many places: chains of links."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    rows = []
    for k in range(60):
        w = list(base)
        for p in rng.integers(0, 120, int(rng.integers(0, 4))):
            w[p] = f"x{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        got = {r[0]: (r[1], r[2]) for r in
               ngram_join.jaccard_components(df, n=n, percent=percent).collect()}
        assert got == brute_components(rows, n, percent)


def test_ngram_product_of_a_block():
    """Entries of a block, rows without columns among them, equal the overlaps of each pair."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, n).astype(np.uint64) << np.uint64(58 - n % 3))
            for n in (0, 1, 5, 30, 60, 200, 200, 3)]
    pairs = [(a, b) for a in rows for b in rows]
    for percent in (73, 90, 100):
        got = ngram_join.product(*(f(side) for side in zip(*pairs) for f in (
            np.concatenate, lambda s: np.array([r.size for r in s]))), percent)
        want = [np.intersect1d(a, b).size for a, b in pairs]
        want = [w if 100 * w >= percent * (a.size + b.size - w) else -1
                for w, (a, b) in zip(want, pairs)]
        assert got.tolist() == want


def test_ngram_signatures_meet():
    """Linked sets of any size share a signature."""
    rng = np.random.default_rng(5)
    bands = ngram_join.size_bands(3000)
    for percent in (75, 80, 90, 99):
        for size in (1, 2, 3, 5, 9, 10, 19, 40, 100, 400, 1500):
            for _ in range(15):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
                out = rng.integers(0, (100 - percent) * size // 100 + 1)
                new = rng.integers(0, (100 - percent) * size // 100 + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(
                    0, 1 << 63, new, dtype=np.uint64)]))
                same = np.intersect1d(a, b).size
                linked = 100 * same >= percent * (a.size + b.size - same)
                got = ngram_join.product(a, np.array([a.size]), b, np.array([b.size]), percent)
                assert got.tolist() == [same if linked else -1]
                if linked:
                    assert np.intersect1d(ngram_join.block_signatures(a, percent, bands),
                                          ngram_join.block_signatures(b, percent, bands)).size


def test_ngram_join_edges(spark, edge):
    got = [(r[0], r[1], r[2]) for r in ngram_join.jaccard_components(edge).collect()]
    assert len(got) == len(EDGE)
    by_key = {r[0]: r[1:] for r in got}
    assert by_key[1] == (0, 1) and by_key[2] == (0, 2) and by_key[3] == (0, 3)
    assert by_key[4] == (1, 4) and by_key[5] == (1, 4) and by_key[None][1] is None
    assert by_key[6] == (4, 6)
    kept = ngram_join.keep_first(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_keep_first_of_repeated_and_keyless_rows(spark):
    near = " ".join(f"v{k}" for k in range(100))
    rows = [(3, "one two three four five six"), (3, "one two three four five six"),
            (9, "one two three four five six"), (None, "one two three four five six"),
            (None, "copies without a key stay once"), (None, "copies without a key stay once"),
            (None, near), (20, near + " end"), (21, "alone here"), (22, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.keep_first(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        rows[0], rows[4], rows[7], rows[8], rows[9], rows[10]]))


def brute_phrases(text):
    w = word_list(text)
    places = []
    for label, phrase in license_scan.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return (len(w), len(places), min(places)[0] if places else None,
            max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))


def test_license_scan_equals_brute_force(spark, edge):
    found = queries.op4_license_scan(spark, SF).collect()
    have = texts(spark)
    assert len(found) == len(have)
    assert all(tuple(r)[1:6] == brute_phrases(have[r.doc_id]) for r in found)
    got = {r.doc_id: r for r in license_scan.scan_licenses(edge).collect()}
    assert {k: tuple(r)[1:6] for k, r in got.items()} == {k: brute_phrases(t) for k, t in EDGE}
    assert got[8].n_base == 3 and got[8].score == 1.0 and got[1].score == 0.0


def test_license_templates_survive_edits(spark):
    mit = dict(license_scan.TEMPLATES)["mit"].split()
    cut = "x y " + " ".join(mit[:6] + ["oh"] + mit[6:])
    rows = [(1, cut), (2, " ".join(mit[:8])), (3, " ".join(reversed(mit)))]
    got = {r.doc_id: r for r in license_scan.scan_licenses(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].spans[0].start == 2 and got[1].base_labels == ""
    assert got[2].labels == "" and got[3].labels == "" and got[2].score == 0.0


def brute_chain(words, template):
    """Longest ascending chain of template pairs that a text holds."""
    pairs = list(zip(template, template[1:]))
    best = {}
    for p in range(len(words) - 1):
        new = {q: 1 + max([v for k, v in best.items() if k < q], default=0)
               for q, pair in enumerate(pairs) if pair == tuple(words[p:p + 2])}
        for q, v in new.items():
            best[q] = max(best.get(q, 0), v)
    return max(best.values(), default=0) / len(pairs)


def test_license_spans_are_verified_in_order(spark):
    mit = dict(license_scan.TEMPLATES)["mit"].split()
    pairs = [mit[k:k + 2] for k in range(0, len(mit), 2)]
    rows = [(1, " ".join(mit[:15] + "one two three four five".split() + mit[15:])),
            (2, " ".join(w for pair in reversed(pairs) for w in pair)),
            (3, "Released under the MIT License."), (4, "Licensed under CC BY 4.0."),
            (5, "Licensed under CC BY-NC 4.0."), (6, "under the mit something license"),
            (7, " ".join(mit + mit)),
            (8, "Licensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[2].labels == "" and got[2].spans is None
    assert abs(got[1].score - brute_chain(rows[0][1].split(), mit)) < 1e-12
    assert got[3].labels == "mit" and got[4].labels == "cc-by" and got[6].labels == ""
    assert got[5].labels == "cc-by,cc-by-nc" and got[8].labels == "apache"
    assert got[7].score == 1.0 and len(got[7].spans) == 2


def test_license_scan_is_native():
    src = open(license_scan.__file__).read()
    assert not re.search(r"udf|pandas|InArrow|\.rdd|numpy", src)


def test_bpe_equals_library(spark, edge):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(common.tokenizer_file("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    for df, have in ((spark.read.parquet(f"{SF}/documents.parquet"), texts(spark)),
                     (edge, dict(EDGE))):
        for r in bpe.encode_documents(df.select("doc_id", "text"), keep=("doc_id",),
                                      digests=True).collect():
            ids = t.encode(have[r.doc_id] or "", add_special_tokens=False).ids
            text = t.decode(ids, skip_special_tokens=False)
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_packed_ids_round_trip(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(common.tokenizer_file("byte_bpe_50k.json"))
    have, start = texts(spark), 0
    got = {r.doc_id: r for r in queries.op5_packed_ids(spark, SF).collect()}
    assert len(got) == len(have)
    for k in sorted(have):
        ids = np.array(t.encode(have[k] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (
            start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_decontamination_equals_brute_force(spark):
    have = texts(spark)
    bench = [(str(r.item_id), r.text or "") for r in
             spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:25]
    keys = sorted(have)[:40]
    df = spark.createDataFrame([(k, have[k]) for k in keys], "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id string, text string")
    got = {r.doc_id: r for r in decontam.find_contamination(df, items).collect()}
    want = decontam.brute_force([have[k] for k in keys], bench)
    assert [(got[k].n_words, got[k].n_hit, list(got[k].items)) for k in keys] == [
        (a, b, c) for a, b, c, _ in want]


def test_decontamination_by_items_without_id(spark, tmp_path):
    import duckdb
    from grove.llm.oracle import OP9
    words = [f"w{k}" for k in range(60)]
    docs = [(1, " ".join(words[:30])), (2, " ".join(words[20:50])), (3, "nothing of it"), (4, None)]
    bench = [(None, " ".join(words[5:17])), (None, " ".join(words[12:24])),
             ("7", " ".join(words[22:40])), ("8", None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in queries.op9_decontaminate(spark, f"file://{tmp_path}").collect()}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == set(con.execute(OP9).fetchall())
    assert {r[0]: r[2:4] for r in got} == {1: (19, 1), 2: (18, 1), 3: (0, 0), 4: (0, 0)}


def test_fertility_base_counts(spark, edge):
    for df, have in ((spark.read.parquet(f"{SF}/documents.parquet"), texts(spark)),
                     (edge, dict(EDGE))):
        for r in fertility.quality_rules(df, keep=("doc_id",)).collect():
            t = have[r.doc_id] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            places = defaultdict(list)
            for i in range(len(w) - 2):
                places[tuple(w[i:i + 3])].append(i)
            hit = {i + d for p in places.values() if len(p) > 1 for i in p for d in range(3)}
            seen, dup = set(), 0
            for line in t.split("\n"):
                if re.search(r"[^\x20\x09-\x0D]", line):
                    dup += line in seen
                    seen.add(line)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
                len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))
            assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


@pytest.mark.parametrize("size", [60, 150])
def test_fertility_rejects_short_gibberish(spark, size):
    rng = np.random.default_rng(size)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = [(f"junk-{lang}-{k}", " ".join("".join(rng.choice(letters, rng.integers(2, 11)))
                                          for _ in range(size)), lang)
            for lang in ("en", "de", "fr", "es") for k in range(5)]
    seen = defaultdict(int)
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        w = (r.text or "").split()
        if r.lang and len(w) >= size and seen[r.lang] < 5 and not re.search(r"[|#*$%&<>]|!!", r.text):
            seen[r.lang] += 1
            rows.append((f"clean-{r.doc_id}", " ".join(w[:size]), r.lang))
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = fertility.quality_rules(df, keep=("doc_id", "lang")).collect()
    assert sum(seen.values()) == 20
    assert not any(r.base_failed for r in got if r.doc_id.startswith("junk"))
    assert {r.doc_id for r in got if r.kept} == {r[0] for r in rows if r[0].startswith("clean")}


def test_language_held_out(spark, edge):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in queries.op8_language_id(spark, SF).collect()]
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(df, common.crc_bucket("doc_id", 5) != 0)
    out = {r.doc_id: r for r in langid.predict(edge, model, keep=("doc_id",)).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (1, 2, 3))


def test_language_never_learned_is_rejected(spark):
    """Whole documents of a language that the fit did not see go, those of the others stay,
    also with texts in two of them, and with keys and numbers in a text."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200")
    model = langid.fit(df, (common.crc_bucket("doc_id", 5) != 0) & (F.col("lang") != "es"))
    got = langid.predict(df, model).groupBy(F.col("lang") == "es").agg(
        F.avg(F.col("rejected").cast("int"))).collect()
    share = {r[0]: r[1] for r in got}
    assert share[True] > 0.95 and share[False] < 0.01
    by = {r.lang: r.text for r in df.where("n_chars < 900").orderBy("doc_id").collect()}
    odd = spark.createDataFrame([(1, by["de"] + " " + by["fr"]), (2, by["en"] + " 9f3a41" * 300)],
                                "doc_id long, text string")
    assert langid.predict(odd, model).where("rejected").count() == 0


def test_quality_held_out(spark, edge):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op6_pu_quality(spark, sf).collect()
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.88
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert pu_quality.score_quality(edge, None).where("score = 0.5").count() == len(EDGE)


def test_url_rules(spark):
    urls = [(1, "http://A.Example.ORG/es/x"), (2, "http://example.org/en/12?q"), (3, None),
            (4, "https://x.com/de/a"), (5, "https://com/fr/"), (6, "no scheme"), (7, "http://net/")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in
           url_trie.filter_urls(df, queries.URL_RULES, keep=("page_id",)).collect()}
    assert got[1] == ("example.org/es/", "block") and got[2] == ("example.org/en/1", "block")
    assert got[4] == ("com/de/", "block") and got[5] == ("com/fr/", "allow")
    assert got[3][0] is None and got[6][0] is None and got[7][0] is None


def test_main_text_edges(spark):
    body = "<p>" + "plain words of an article, and more of them. " * 12 + "</p>"
    rows = [(1, None), (2, ""), (3, "<html><body><nav><a href=a>Menu</a></nav><article>" + body
                                 + body.replace("plain", "caf&eacute;")
                                 + "</article><footer>foot</footer></body></html>")]
    df = spark.createDataFrame([(k, f"http://a/{k}", h) for k, h in rows],
                               "page_id long, url string, html string")
    got = {r.page_id: r for r in html_density.extract_main_text(df, keep=("page_id", "url"))
           .collect()}
    assert got[1].text == "" and got[2].n_chars == 0
    assert "café words" in got[3].text and "Menu" not in got[3].text and "foot" not in got[3].text
    assert got[3].n_chars == len(got[3].text) and got[3].text.count("\n") == 1


PROSE = "<p>" + "plain words of an article, and more of them. " * 12 + "</p>"


def test_main_text_behind_script_after_dotted_i():
    page = ("<html><body><h1>İstanbul İİİ</h1><script>var a = '<p>';</SCRIPT>" + PROSE
            + "<script>b()</script><p>" + "the last words of the page. " * 9 + "</p></body></html>")
    text = html_density.main_text(page)
    assert "plain words" in text and "the last words" in text and "var a" not in text


@pytest.mark.parametrize("tag", ["font", "span", "div"])
def test_main_text_below_5000_open_tags(tag):
    page = "<body><p>before all of it</p>" + f"<{tag}>" * 5000 + PROSE + PROSE + "</body>"
    text = html_density.main_text(page)
    assert text.count("plain words") == 24 and text.startswith("before all of it\n")


LINKS = "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(12))


@pytest.mark.parametrize("attrs", ['class="content no-sidebar"', 'id="page" class="has-cookie-notice"',
                                   'class="single has-comments"'])
def test_main_text_in_wrapper_with_boilerplate_words(attrs):
    page = (f"<body><div {attrs}><div class='search-on'><h1>Title</h1>{PROSE}{PROSE}</div>"
            "<div class='sidebar'><p>side words</p></div><div class='comments'><p>"
            + "a reader says so. " * 9 + "</p></div></div><div class='share'>tell all</div></body>")
    text = html_density.main_text(page)
    assert text.count("plain words") == 24 and "Title" in text
    assert not re.search("side words|reader|tell all", text)


def test_main_text_leaves_long_comments_out():
    page = (f"<body><div class='post no-sidebar'>{PROSE}</div><div class='comments'>"
            + "<p>a reader says so, and says it again.</p>" * 100 + "</div></body>")
    assert html_density.main_text(page) == html_density.main_text(PROSE)


@pytest.mark.parametrize("wrap", ["{}", "<div class='no-sidebar'>{}</div>"])
def test_main_text_of_several_articles(wrap):
    page = "<body>" + wrap.format(
        f"<article><h2><a href=/1>First</a></h2>{PROSE}<ul>{LINKS}</ul></article>"
        f"<article><h2>Second</h2><div>{PROSE.replace('plain', '<a href=/x>other</a>')}"
        f"<ul>{LINKS}</ul></div></article><article><ul>{LINKS}</ul></article>") + "</body>"
    text = html_density.main_text(page)
    assert text.count("plain words") == 12 and text.count("other words") == 12
    assert "First" in text and "Second" in text and "link 3" not in text


def test_empty_tables(spark, edge):
    none = edge.where("doc_id = -1")
    assert ngram_join.jaccard_components(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert fertility.quality_rules(none).count() == 0
    assert langid.fit(none, common.crc_bucket("doc_id", 5) != 0) is None
    assert langid.predict(none, None).count() == 0


def test_pipeline_equals_operators(spark):
    import corpus_pipeline as cp
    assert [s for s, _ in cp.STAGES] == ["language_id", "quality_rules", "ngram_jaccard",
                                         "decontamination", "bpe"]
    got = {r.doc_id for r in cp.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, common.crc_bucket("doc_id", 5) != 0)
    ok = {r.doc_id for r in langid.predict(docs, model).where("not rejected").collect()}
    ok &= {r.doc_id for r in fertility.quality_rules(docs).where("kept").collect()}
    have = texts(spark)
    comp = brute_components([(k, have[k]) for k in ok], 5, 80)
    ok = {k for k in ok if comp[k][1] == k}
    bad = {r.doc_id for r in queries.op9_decontaminate(spark, SF).where("contaminated").collect()}
    assert got == ok - bad


def test_components_end_as_soon_as_the_edges_are_stars(spark, monkeypatch):
    written = []

    def shared_table(df, name):
        written.append(name)
        return common.shared_table(df, name)

    monkeypatch.setattr(ngram_join, "shared_table", shared_table)

    def roots(pairs):
        written.clear()
        links = spark.createDataFrame(pairs, "a long, b long")
        return {r.node: r.root for r in ngram_join.components(links).collect()}

    assert roots([(1, k) for k in range(2, 9)] + [(20, 21)]) == {
        **{k: 1 for k in range(1, 9)}, 20: 20, 21: 20}
    assert len(written) == 1
    # a chain in mixed order, a pair twice and a link to itself
    chain = [7, 3, 9, 1, 8, 2, 6, 4, 5]
    assert roots([*zip(chain, chain[1:]), (11, 12), (12, 11), (13, 13)]) == {
        **{k: 1 for k in chain}, 11: 11, 12: 11}
    assert roots([]) == {}


def test_language_fit_gives_the_memory_of_its_sample_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(langid, "return_memory", lambda: given.append(1))
    docs = spark.createDataFrame([(k, "the cat and the dog" if k % 2 else "der hund und die katze",
                                   "en" if k % 2 else "de") for k in range(40)],
                                 "doc_id long, text string, lang string")
    assert langid.fit(docs, F.lit(True), epochs=1).langs == ["de", "en"]
    assert given == [1]
