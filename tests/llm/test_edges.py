"""Clashing column names, empty tables, repeated rows, null keys and long texts, of every operator
that keeps its input's columns, and of the id files."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grove.llm import (bpe, common, decontam, fertility, fim, html_density, langid, ngram_join,
                       packed_ids, periodic, pu_quality, substring_dedup, url_trie)

NAMES = "_text _TEXT_ _url _page _row _order _rid _starts _h1 _key _x".split()
LONG = "word after word " * 60_000
ROWS = [(1, "one two three"), (1, "one two three"), (None, "one two three"), (2, None), (3, ""), (4, LONG)]


def contaminated(docs):
    items = docs.sparkSession.createDataFrame([(7, "one two three")], "item_id long, text string")
    return decontam.find_contamination(docs, items)


def identified(docs):
    model = langid.fit(docs.withColumn("lang", F.lit("xx")), F.lit(True))
    return langid.predict(docs, model)


OPERATORS = {
    "fertility": fertility.quality_rules, "bpe": bpe.encode_documents, "fim": fim.fill_in_middle,
    "periodic": periodic.find_runs, "substring_dedup": substring_dedup.remove_repeats,
    "decontam": contaminated, "langid": identified, "ngram_join": ngram_join.keep_first,
    "pu_quality": lambda docs: pu_quality.score_quality(docs, None),
    "url_trie": lambda docs: url_trie.filter_urls(docs, [("allow", "org/")], url="text"),
    "html_density": lambda docs: html_density.extract_main_text(docs, page="text").withColumn(
        "text", F.lit("replaced")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_and_edge_rows(spark, name):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select(
        "*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)])
    out = OPERATORS[name](docs)
    assert set(docs.columns) <= set(out.columns)
    rows = out.collect()
    if name == "ngram_join":          # one row of a group stays
        assert sorted((r.doc_id, r.text) for r in rows) == sorted([ROWS[0], *ROWS[3:]])
    else:
        assert len(rows) == len(ROWS)
        assert [r for r in rows if r.doc_id == 1][0] == [r for r in rows if r.doc_id == 1][1]
    for r in rows:
        assert [r[c] for c in NAMES] == list(range(len(NAMES)))
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_id_files_keep_null_keys_and_refuse_text_keys(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = packed_ids.read_ids(packed_ids.write_ids(docs, packed_ids.fresh_folder(spark)), whole=False)
    assert sorted((r.key for r in got.collect()), key=repr) == sorted((k for k, _ in ROWS), key=repr)
    empty = packed_ids.write_ids(docs.limit(0), packed_ids.fresh_folder(spark))
    assert empty.count() == 0 and packed_ids.read_ids(empty).count() == 0
    with pytest.raises(ValueError):
        packed_ids.write_ids(docs.withColumn("doc_id", F.lit("a")), packed_ids.fresh_folder(spark))


def test_id_table_forgets_rare_words(monkeypatch):
    monkeypatch.setattr(packed_ids, "CACHE_WORDS", 40)
    coder = packed_ids.Encoder(common.tokenizer_file(packed_ids.VOCABULARY))
    for k in range(30):
        texts = [f"the same words again {k} and\nnumber{k * 7} {'x' * 80}{k}".encode(), b"the same\nwords", b"",
                 b"a\0b c", b" lead", "wide space".encode()]
        want = [coder.library.encode(t.decode(), add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in coder.encode(texts)] == want
        assert len(coder.words) < 80


def test_marks_are_words_of_their_own():
    coder = packed_ids.Encoder(common.tokenizer_file(packed_ids.VOCABULARY))
    coder.encode([b"word, word. word) word\nword"])
    assert set(coder.words) == {b"word", b" word", b",", b".", b")", b"\n"}
    parts = ["a", "B", "9", "\u00e9", "\u00df", " ", "\n", ",", ".", "'", "'s", "t", "!", "-", "\u6f22", "<",
             ">", ")", "?", "\u0301", "\u0663", "\u00b2", "_", '"', "\u2019", "\u01c5", "\u00aa"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))).encode() for _ in range(5000)]
    want = [e.ids for e in coder.library.encode_batch([t.decode() for t in texts],
                                                      add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(texts)] == want


def test_id_table_is_kept_from_task_to_task():
    file = common.tokenizer_file(packed_ids.VOCABULARY)
    common._TABLE.clear()
    coder = common.kept_table(packed_ids.TABLE, file, lambda: packed_ids.Encoder(file))
    words = [f"{k:x}q" for k in range(60_000)]
    batch = pa.RecordBatch.from_pydict({"_text": [" ".join(words + words)]})
    for _, texts in common.slices(iter([batch]), "_text", table=packed_ids.TABLE,
                                  idle=packed_ids.CACHE_WORDS // 2):
        coder.encode(texts)
    assert len(coder.words) > 59_000
    common._TABLE.clear()


class Table:
    def __init__(self):
        self.cut = []

    def shrink(self, words):
        self.cut.append(words)


def test_kept_text_goes_to_python_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id int, text string")
    sent, real = [], type(docs).mapInArrow

    def spy(self, *args, **more):
        sent.append(self.columns)
        return real(self, *args, **more)

    items = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", spy)
    fertility.quality_rules(docs)
    langid.predict(docs, None)
    decontam.find_contamination(docs, items)
    bpe.encode_documents(docs)
    assert sent == [["doc_id", "text"]] * 4
    fertility.quality_rules(docs, keep=("doc_id",))
    fertility.quality_rules(docs.withColumn("text", F.lit(5)))
    assert sent[4:] == [["doc_id", "_text"], ["doc_id", "text", "_text"]]


def test_new_words_are_encoded_in_runs(monkeypatch):
    v = fertility.Vocabularies(common.tokenizer_file("byte_bpe_50k.json"),
                               common.tokenizer_file("piece_bpe_32k.model"))
    words = [f"w{k}ord".encode() for k in range(1000)]
    v.numbers(words)
    whole = v.bpe_n.tolist(), v.ids.tolist(), v.at.tolist()
    most, real = [], v.piece.encode
    monkeypatch.setattr(fertility, "FRESH_WORDS", 64)
    monkeypatch.setattr(v.piece, "encode", lambda text, **more: (most.append(len(text)),
                                                                 real(text, **more))[1])
    v.reset()
    v.numbers(words)
    assert (v.bpe_n.tolist(), v.ids.tolist(), v.at.tolist()) == whole
    assert max(most) == 64


def test_tables_are_cut_back_and_those_of_another_operator_freed():
    common._TABLE.clear()
    table = common.kept_table("a", 1, Table)
    assert common.kept_table("a", 1, Table) is table
    list(common.slices(iter(()), "t", table="a"))
    assert common._TABLE == ["a", 1, table] and table.cut == [common.IDLE_WORDS]
    list(common.slices(iter(()), "t"))
    assert common._TABLE == []
    common.kept_table("a", 2, Table)
    other = common.kept_table("b", 2, Table)
    assert common._TABLE == ["b", 2, other]
    common._TABLE.clear()


def test_fertility_is_the_same_after_its_table_was_cut(monkeypatch):
    v = fertility.Vocabularies(common.tokenizer_file("byte_bpe_50k.json"),
                               common.tokenizer_file("piece_bpe_32k.model"))
    words = [f"word{k}".encode() for k in range(300)]
    want = [tuple(v.ids[v.at[n]:v.at[n + 1]]) + (v.bpe_n[n],) for n in v.numbers(words)]
    v.shrink(40)
    assert len(v.index) == 40 == v.bpe_n.size
    got = [tuple(v.ids[v.at[n]:v.at[n + 1]]) + (v.bpe_n[n],) for n in v.numbers(words[::-1])]
    assert got == want[::-1]
