"""Training frames built from the driver's tables (FIXTURES.md section 3).

Each builder returns a :class:`Fixture`: a lazy DataFrame plus the names of its
target, feature columns, row key and task.  All of them read whole tables;
features are built-in column expressions (no Python per row), so Catalyst
prunes the scan to the columns used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.operators.dataset import Fixture
from grove.sources.tables import table


def net_price_expr() -> Column:
    return F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))


def net_price(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> Fixture:
    """Regression: net price of a line from its price, discount and quantity."""
    li = table(spark, sf_dir, "lineitem", partitions)
    frame = li.select("l_orderkey", "l_linenumber",
                      net_price_expr().alias("net_price"),
                      "l_extendedprice", "l_discount", "l_quantity")
    return Fixture(frame, "net_price", ["l_extendedprice", "l_discount", "l_quantity"],
                   ["l_orderkey"], "regression")


def _words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def text_features(text: Column) -> list[Column]:
    """Word count, share of non-letters and share of distinct words of a whole text."""
    words = _words(text)
    n_words = F.when(F.length(F.trim(text)) == 0, F.lit(0)).otherwise(F.size(words))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    non_letter = F.try_divide((F.length(text) - letters).cast("double"),
                              F.length(text).cast("double"))
    distinct = F.try_divide(F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w))))
                            .cast("double"), n_words.cast("double"))
    return [n_words.cast("double").alias("n_words"),
            F.coalesce(non_letter, F.lit(0.0)).alias("non_letter_share"),
            F.coalesce(distinct, F.lit(0.0)).alias("distinct_share")]


def doc_quality(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> Fixture:
    """Binary: quality label of a document from its length and word statistics.

    The four numbers are computed before the join, so no text is shuffled by it.
    """
    docs = table(spark, sf_dir, "documents", partitions).select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), *text_features(F.col("text")))
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("quality"))
    # Plain equi-join: AQE broadcasts the labels side at run time only when its
    # measured size is under the threshold, otherwise it sort-merges.
    frame = labels.join(docs, "doc_id").select(
        "doc_id", "quality", "n_chars", "n_words", "non_letter_share", "distinct_share")
    return Fixture(frame, "quality",
                   ["n_chars", "n_words", "non_letter_share", "distinct_share"],
                   ["doc_id"], "binary", positive=1.0)


# The 16 letters whose shares describe a text's language.
LANG_LETTERS = ["a", "c", "e", "h", "k", "o", "q", "t", "u", "w", "x", "z",
                "é", "ñ", "ó", "ü"]


def letter_share(text: Column, letter: str) -> Column:
    low = F.lower(text)
    hits = F.length(low) - F.length(F.replace(low, F.lit(letter), F.lit("")))
    return F.coalesce(F.try_divide(hits.cast("double"), F.length(low).cast("double")),
                      F.lit(0.0))


def doc_lang(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> Fixture:
    """Multiclass: language of a document from its letter shares (0 for a blank or null text)."""
    docs = table(spark, sf_dir, "documents", partitions).select("doc_id", "text", "lang")
    names = [f"share_{i:02d}" for i in range(len(LANG_LETTERS))]
    frame = docs.select("doc_id", "lang",
                        *[letter_share(F.col("text"), c).alias(n)
                          for c, n in zip(LANG_LETTERS, names)])
    return Fixture(frame, "lang", names, ["doc_id"], "multiclass")


def embedding_label(spark: SparkSession, sf_dir: str) -> Fixture:
    """Multiclass on a ready 64-wide vector column (shape only; labels are noise)."""
    emb = table(spark, sf_dir, "embeddings")
    frame = emb.select("vec_id", F.col("label").cast("double").alias("label"),
                       F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return Fixture(frame, "label", [], ["vec_id"], "multiclass", vector="embedding")


def order_noise(spark: SparkSession, sf_dir: str) -> Fixture:
    """Regression with no signal: total price from customer key and month."""
    o = table(spark, sf_dir, "orders")
    frame = o.select("o_orderkey", "o_totalprice",
                     F.col("o_custkey").cast("double").alias("o_custkey"),
                     F.month("o_orderdate").cast("double").alias("o_month"))
    return Fixture(frame, "o_totalprice", ["o_custkey", "o_month"], ["o_orderkey"],
                   "regression")


def flag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actual, predicted) class pairs: return flag vs a rule on quantity."""
    li = table(spark, sf_dir, "lineitem")
    predicted = (F.when(F.col("l_quantity") < 15, "A")
                 .when(F.col("l_quantity") < 33, "N").otherwise("R"))
    return li.select("l_orderkey", F.col("l_returnflag").alias("actual"),
                     predicted.alias("predicted"))


def price_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, prediction) pairs: net price vs 95 % of the list price."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", net_price_expr().alias("label"),
                     (F.col("l_extendedprice") * 0.95).alias("prediction"))


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score) pairs with many ties: status F vs customer key mod 97."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey",
                    F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"),
                    (F.col("o_custkey") % 97).cast("double").alias("score"))


WIDE_FEATURES = 512


def wide_docs(spark: SparkSession, sf_dir: str, partitions: int | None = None,
              width: int = WIDE_FEATURES) -> Fixture:
    """Wide regression in the reference's shape: one row per document, ``width``
    hashed token counts of the whole text as features, log length as target.

    HashingTF runs inside the JVM, row by row, with no shuffle; the result is a
    sparse vector, so width costs nothing for short texts.
    """
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    docs = table(spark, sf_dir, "documents", partitions).select("doc_id", "text", "n_chars")
    tokens = RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\W+",
                            toLowercase=True).transform(docs)
    hashed = HashingTF(inputCol="tokens", outputCol="token_counts",
                       numFeatures=width).transform(tokens)
    frame = hashed.select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("log_chars"),
                          "token_counts")
    return Fixture(frame, "log_chars", [], ["doc_id"], "regression", vector="token_counts")

