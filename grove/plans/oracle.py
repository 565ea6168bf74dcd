"""DuckDB twins of the exact queries (views: the driver's tables by name).

Column names and types follow the Spark side: counts BIGINT, figures DOUBLE
rounded like the Spark code, labels and indexes DOUBLE.
"""

from __future__ import annotations

# md5 digits 1-8 -> split bucket, digits 9-16 -> fold (same digest as Spark's md5).
_BUCKET = "(('0x' || substr(md5(cast({k} as varchar)), 1, 8))::UBIGINT % 10000)"
_FOLD = "cast(('0x' || substr(md5(cast({k} as varchar)), 9, 8))::UBIGINT % {n} as INTEGER)"


def bucket(k: str) -> str:
    return _BUCKET.format(k=k)


def fold(k: str, n: int) -> str:
    return _FOLD.format(k=k, n=n)


TEST_BUCKETS = 2000  # round((1 - 0.8) * 10000)

NET = ("l_extendedprice * (1 - l_discount) AS net_price, l_extendedprice, l_discount, "
       "l_quantity")

FLAG_PAIRS = """(SELECT l_orderkey, l_returnflag AS a,
        CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 33 THEN 'N' ELSE 'R' END AS p
 FROM lineitem)"""


def agreement_sql(pairs: str, cols: str) -> str:
    """kappa / ba / accuracy / n from a relation pr(a, p)."""
    return f"""
WITH pr AS {pairs},
cm AS (SELECT a, p, count(*) AS n FROM pr GROUP BY a, p),
tot AS (SELECT sum(n) AS t, sum(CASE WHEN a = p THEN n ELSE 0 END) AS d FROM cm),
ra AS (SELECT a AS k, sum(n) AS r FROM cm GROUP BY a),
cp AS (SELECT p AS k, sum(n) AS c FROM cm GROUP BY p),
pe AS (SELECT sum(cast(r AS DOUBLE) * cast(c AS DOUBLE)) AS s FROM ra JOIN cp ON ra.k = cp.k),
ba AS (SELECT avg(cast(coalesce(n, 0) AS DOUBLE) / r) AS b
       FROM ra LEFT JOIN cm ON cm.a = ra.k AND cm.p = ra.k),
f AS (SELECT cast(d AS DOUBLE) / t AS p0, s / (cast(t AS DOUBLE) * t) AS pe, b, t FROM tot, pe, ba)
SELECT {cols} FROM f"""


KAPPA = "round((p0 - pe) / nullif(1 - pe, 0), 6) AS kappa"
BA = "round(b, 6) AS ba"
ACC = "round(p0, 6) AS accuracy"
N = "cast(t AS BIGINT) AS n"

SCORE_PAIRS = """(SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS label,
        cast(o_custkey % 97 AS DOUBLE) AS score FROM orders)"""


def auc_sql(pairs: str) -> str:
    """Exact AUC with ties as one half."""
    return f"""(WITH sp AS {pairs},
g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sp GROUP BY score),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                                 AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM c)"""


# The columns of lineitem and the kind that each is profiled in.
LINEITEM_KINDS = {
    "l_orderkey": "long", "l_partkey": "long", "l_suppkey": "long", "l_linenumber": "long",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double",
    "l_tax": "double", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"}


def profile_sql(table: str, kinds: dict[str, str]) -> str:
    """One row per column, its ends in the column's own kind."""
    types = {"long": "VARCHAR", "double": "DOUBLE", "text": "VARCHAR"}

    def end(column: str, kind: str, shape: str, f: str) -> str:
        if shape != ("text" if kind == "time" else kind):
            return f"CAST(NULL AS {types[shape]})"
        if kind == "time":
            return f"strftime({f}({column}), '%Y-%m-%d %H:%M:%S.%f')"
        return f"CAST({f}({column}) AS {types[shape]})" + (" + 0.0" if kind == "double" else "")

    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, "
        + ", ".join(f"{end(c, k, t, f)} AS {f}_{t}" for t in types for f in ("min", "max"))
        + f" FROM {table}" for c, k in kinds.items())


CATEGORY_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]

ORACLE: dict[str, str] = {
    "scan_delimited": f"SELECT {NET} FROM lineitem",
    "cast_target": "SELECT l_extendedprice * (1 - l_discount) AS net_price FROM lineitem",
    "positional_label": ("SELECT l_extendedprice * (1 - l_discount) AS label, l_extendedprice, "
                         "l_discount, l_quantity FROM lineitem"),
    "class_label_scan": ("SELECT cast(l_linenumber - 1 AS DOUBLE) AS label, l_quantity, "
                         "l_discount, l_tax FROM lineitem"),
    "drop_repeated_header": f"SELECT {NET} FROM lineitem",
    "external_validation": (f"SELECT {NET}, CASE WHEN {bucket('l_orderkey')} < {TEST_BUCKETS} "
                            "THEN 'test' ELSE 'train' END AS side FROM lineitem"),
    "parse_bracketed": ("SELECT l_extendedprice AS target, l_discount AS v1, l_quantity AS v2, "
                        "3 AS n_values FROM lineitem"),
    "export_split": (f"SELECT CASE WHEN {bucket('l_orderkey')} < {TEST_BUCKETS} THEN 'test' "
                     "ELSE 'train' END AS side, count(*) AS n_rows, "
                     "round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_label "
                     "FROM lineitem GROUP BY 1"),
    "holdout_split": (f"SELECT o_orderkey, CASE WHEN {bucket('o_orderkey')} < {TEST_BUCKETS} "
                      "THEN 'test' ELSE 'train' END AS side FROM orders"),
    "fold_assignment": (f"SELECT o_orderkey, {fold('o_orderkey', 3)} AS fold FROM orders "
                        f"WHERE {bucket('o_orderkey')} >= {TEST_BUCKETS}"),
    "assemble_features": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) "
                          "AS net_price, l_extendedprice AS f0, l_discount AS f1, "
                          "l_quantity AS f2 FROM lineitem"),
    "preview": ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, "
                "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate "
                "FROM orders ORDER BY o_orderkey LIMIT 5"),
    "dataset_profile": profile_sql("lineitem", LINEITEM_KINDS),
    "index_labels": """
SELECT d.doc_id, d.lang, r.lang_index FROM documents d JOIN (
  SELECT lang, cast(row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS DOUBLE) AS lang_index
  FROM documents GROUP BY lang) r ON d.lang = r.lang""",
    "class_weights": """
SELECT d.doc_id, d.lang, round(w.weight, 6) AS weight FROM documents d JOIN (
  SELECT lang, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
  FROM documents GROUP BY lang) w ON d.lang = w.lang""",
    "index_categories": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(DISTINCT {c}) <= 16 AS categorical, "
        f"CASE WHEN count(DISTINCT {c}) <= 16 THEN count(DISTINCT {c}) ELSE 0 END AS n_categories "
        "FROM lineitem" for c in CATEGORY_COLUMNS),
    "confusion_matrix": ("SELECT l_returnflag AS actual, CASE WHEN l_quantity < 15 THEN 'A' "
                         "WHEN l_quantity < 33 THEN 'N' ELSE 'R' END AS predicted, "
                         "count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "cohen_kappa": agreement_sql(FLAG_PAIRS, KAPPA),
    "balanced_accuracy": agreement_sql(FLAG_PAIRS, BA),
    "accuracy": agreement_sql(FLAG_PAIRS, ACC),
    "regression_metrics": """
WITH pr AS (SELECT l_extendedprice * (1 - l_discount) AS y, l_extendedprice * 0.95 AS p
            FROM lineitem),
m AS (SELECT avg(y) AS mu FROM pr)
SELECT round(avg((y - p) * (y - p)), 4) AS mse,
       round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
       round(avg(abs(y - p)), 4) AS mae,
       round(1 - sum((y - p) * (y - p)) / nullif(sum((y - mu) * (y - mu)), 0), 6) AS r2,
       round(avg((p - mu) * (p - mu)), 4) AS explained_variance,
       count(*) AS n
FROM pr, m""",
    "area_under_roc": "SELECT * FROM " + auc_sql(SCORE_PAIRS),
    "binary_report": agreement_sql(
        """(SELECT label AS a, CASE WHEN score >= 48 THEN 1.0 ELSE 0.0 END AS p
            FROM """ + SCORE_PAIRS + ")",
        f"{KAPPA}, {BA}, {ACC}, {N}, (SELECT auc FROM {auc_sql(SCORE_PAIRS)}) AS auc"),
    "classification_report": agreement_sql(
        f"(SELECT * FROM {FLAG_PAIRS} WHERE {bucket('l_orderkey')} < {TEST_BUCKETS})",
        f"{KAPPA}, {BA}, {ACC}, {N}"),
}

# ------------------------------------------------------------------ thresholds

ORACLE["roc_points"] = f"""
WITH g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM {SCORE_PAIRS} GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n
      FROM g WINDOW w AS (ORDER BY score DESC)),
k AS (SELECT *, (tp + n - fp) / (p + n) AS hit,
             ((tp + fp) * p + (p - tp + n - fp) * n) / ((p + n) * (p + n)) AS chance FROM c)
SELECT score AS threshold, CAST(pos AS BIGINT) AS n_pos, CAST(neg AS BIGINT) AS n_neg,
       CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / p, 6) AS tpr,
       round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision,
       round((hit - chance) / nullif(1 - chance, 0), 6) AS kappa,
       round((tp / p + 1 - fp / n) / 2, 6) AS ba
FROM k"""

# ------------------------------------------------------------------ chi-squared selection

# As in grove.plans.fixtures.
_LETTERS = ["a", "c", "e", "h", "k", "o", "q", "t", "u", "w", "x", "z", "é", "ñ", "ó", "ü"]
_SHARES = " UNION ALL ".join(
    f"SELECT {i} AS position, lang, round(100 * coalesce((length(low) - length(replace(low, '{c}', '')))"
    f" / nullif(length(low), 0), 0)) AS v FROM d" for i, c in enumerate(_LETTERS))

ORACLE["select_features"] = f"""
WITH d AS (SELECT lang, lower(text) AS low FROM documents WHERE lang IS NOT NULL),
x AS ({_SHARES}),
o AS (SELECT position, v, lang, count(*) AS o FROM x GROUP BY ALL),
t AS (SELECT *, sum(o) OVER (PARTITION BY position, v) AS nv,
             sum(o) OVER (PARTITION BY position, lang) AS nl,
             sum(o) OVER (PARTITION BY position) AS n FROM o),
s AS (SELECT position, max(n) * (sum(CAST(o AS DOUBLE) * o / (CAST(nv AS DOUBLE) * nl)) - 1) AS stat,
             (count(DISTINCT v) - 1) * (count(DISTINCT lang) - 1) AS dof FROM t GROUP BY position),
z AS (SELECT *, CASE WHEN dof > 0 THEN (cbrt(greatest(stat, 0) / dof) - 1 + 2.0 / (9 * dof))
                                       / sqrt(2.0 / (9 * dof)) END AS strength FROM s)
SELECT printf('share_%02d', position) AS feature, CAST(position AS INTEGER) AS position,
       round(stat, 4) AS statistic, CAST(dof AS BIGINT) AS dof,
       row_number() OVER (ORDER BY strength DESC NULLS LAST, position) <= 8 AS selected
FROM z"""

# ------------------------------------------------------------------ models: what is certain of them

_LINE_TEST = f"{bucket('l_orderkey')} < {TEST_BUCKETS}"
_DOC_TEST = f"{bucket('doc_id')} < {TEST_BUCKETS}"
_QUALITY = "(SELECT doc_id FROM labels JOIN documents USING (doc_id))"


def facts(table: str, test: str, **values: object) -> str:
    """One row: rows used, rows judged, and constants or expressions over the table."""
    def sql(v: object) -> str:
        return ("true" if v is True else f"CAST({v} AS BIGINT)" if isinstance(v, int) else str(v))
    return (f"SELECT count(*) AS n_used, count(*) FILTER (WHERE {test}) AS n"
            + "".join(f", {sql(v)} AS {k}" for k, v in values.items()) + f" FROM {table}")


ORACLE |= {
    "train_regression": facts("lineitem", _LINE_TEST, trees=20, fixture="'net_price'", good=True),
    "train_binary": facts(_QUALITY, _DOC_TEST, trees=50, fixture="'doc_quality'", good=True),
    "train_multiclass": facts("documents", _DOC_TEST, trees=20, fixture="'doc_lang'", good=True),
    "train_vector": facts("embeddings", f"{bucket('vec_id')} < {TEST_BUCKETS}", trees=10,
                          n_classes="CAST(max(label) + 1 AS BIGINT)", n_features=64),
    "train_many_classes": facts(
        "lineitem", _LINE_TEST, trees=3, n_classes=150,
        n_actual=f"count(DISTINCT l_partkey % 150) FILTER (WHERE {_LINE_TEST})", good=True),
    "train_unseen_class": facts("documents", _DOC_TEST, trees=20,
                                n_rare=f"count(*) FILTER (WHERE {_DOC_TEST} AND doc_id % 5 = 0)",
                                n_rare_hit=0, good=True),
    "train_weighted": facts("documents", _DOC_TEST, trees=10, good=True),
    "train_selected": facts("documents", _DOC_TEST, trees=20, n_features=8, good=True),
    "tune_regression": facts("lineitem", _LINE_TEST, n_settings=2, good=True, refit_as_chosen=True),
    "wide_tune_regression": facts("documents", _DOC_TEST, n_settings=2, good=True, refit_as_chosen=True),
    "tune_classification": facts("documents", _DOC_TEST, n_settings=2, good=True, refit_as_chosen=True),
    "pipeline_roundtrip": facts("documents", _DOC_TEST, trees=20,
                                n_judged=f"count(*) FILTER (WHERE {_DOC_TEST})", good=True),
    "train_from_vector": facts("documents", _DOC_TEST, trees=20, min_rows=5, subset="'sqrt'",
                               impurity="'entropy'", good=True),
    "save_tuned": facts("documents", _DOC_TEST, n_before=0, n_new="count(*) FILTER (WHERE lang = 'en')",
                        n_new_hit="count(*) FILTER (WHERE lang = 'en')"),
    "wide_regression": facts("documents", _DOC_TEST, trees=50, n_features=512, good=True),
    "train_external": (f"SELECT count(*) FILTER (WHERE NOT {_LINE_TEST}) AS n_used, count(*) FILTER "
                       f"(WHERE {_LINE_TEST}) AS n, CAST(20 AS BIGINT) AS trees, true AS good FROM lineitem"),
    "cv_scores": ("SELECT CAST(t AS INTEGER) AS trees, CAST(32 AS INTEGER) AS bins, 'areaUnderROC' AS metric, "
                  "true AS valid, true AS best_chosen FROM (VALUES (5), (20)) v(t)"),
    "tune_bins": ("SELECT CAST(10 AS INTEGER) AS trees, CAST(b AS INTEGER) AS bins, 'rmse' AS metric, "
                  "true AS valid, true AS best_chosen FROM (VALUES (16), (32)) v(b)"),
    "refit_full": ("SELECT CAST(20 AS INTEGER) AS trees, CAST(3 AS INTEGER) AS n_features, "
                   "'RandomForestRegressionModel' AS kind, true AS depth_kept, true AS binary"),
    "model_summary": ("SELECT CAST(20 AS INTEGER) AS trees, CAST(16 AS INTEGER) AS n_features, "
                      "'RandomForestClassificationModel' AS kind, true AS depth_kept, true AS binary"),
    "model_roundtrip": (f"SELECT count(*) AS n_rows, count(*) AS n_equal FROM documents "
                        f"WHERE {_DOC_TEST}"),
    "score_probability": f"SELECT doc_id, true AS sound FROM {_QUALITY} WHERE {_DOC_TEST}",
    "score_delimited_classes": "SELECT doc_id, true AS known FROM documents",
    "sample_predictions": f"""
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS actual, l_extendedprice AS f0,
       l_discount AS f1, l_quantity AS f2, true AS priced FROM lineitem WHERE {_LINE_TEST}
ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_discount LIMIT 5""",
    "score_bracketed": ("SELECT l_extendedprice AS f0, l_discount AS f1, l_quantity AS f2, "
                        f"true AS priced FROM lineitem WHERE {_LINE_TEST}"),
}
for _name in ("score_batch", "stream_score", "score_delimited"):
    ORACLE[_name] = f"SELECT l_orderkey, l_linenumber, true AS priced FROM lineitem WHERE {_LINE_TEST}"

ORACLE["skip_report"] = """
WITH r AS (SELECT l_extendedprice AS a, CASE WHEN l_quantity > 5 THEN l_discount END AS b,
                  CASE WHEN l_linenumber <> 3 THEN l_quantity END AS c,
                  CASE WHEN l_linenumber < 7 THEN l_extendedprice * (1 - l_discount) END AS y FROM lineitem),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a IS NULL OR b IS NULL OR c IS NULL OR y IS NULL) AS bad,
             count(*) - count(a) AS na, count(*) - count(b) AS nb, count(*) - count(c) AS nc,
             count(*) - count(y) AS ny FROM r)
SELECT v.column_name, n AS n_rows, v.n_unusable, bad AS n_dropped, n - bad AS n_used
FROM t, LATERAL (VALUES ('l_extendedprice', na), ('l_discount', nb), ('l_quantity', nc), ('label', ny))
     v(column_name, n_unusable)"""

# ------------------------------------------------------------------ files without a key


def keyless(label: str) -> str:
    """Rows of the key-less file with their identity: content and number of the copy, as md5."""
    cells = " || ".join(f"length({c}) || ':' || {c}" for c in ("y", "q", "ln", "s"))
    return f"""(SELECT *, md5(content || '#' || (row_number() OVER (PARTITION BY content) - 1)) AS row_key FROM (
  SELECT y, {cells} AS content FROM (
    SELECT CAST({label} AS VARCHAR) AS y, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q,
           CAST(l_linenumber AS VARCHAR) AS ln, CAST(l_suppkey % 5 AS VARCHAR) AS s FROM lineitem)))"""


_NUMBER = "CAST(l_quantity AS INTEGER) * 100 + l_linenumber * 7"
_SIZE = "CASE WHEN l_quantity < 15 THEN 'low' WHEN l_quantity < 33 THEN 'mid' ELSE 'high' END"
_ROW_TEST = f"{bucket('row_key')} < {TEST_BUCKETS}"
ORACLE["file_row_identity"] = f"""
SELECT CASE WHEN {_ROW_TEST} THEN 'test' ELSE 'train' END AS side, count(*) AS n_rows,
       count(DISTINCT row_key) AS n_keys, CAST(sum(CAST(y AS BIGINT)) AS BIGINT) AS label_sum
FROM {keyless(_NUMBER)} GROUP BY 1"""
ORACLE["train_from_file"] = facts(keyless(_NUMBER), _ROW_TEST, trees=10, n_features=3, good=True)
ORACLE["train_from_file_classes"] = facts(keyless(_SIZE), _ROW_TEST, trees=10, n_classes=3, good=True)

# ------------------------------------------------------------------ one split, searched in SQL

_STUMP_ROWS = f"""
rows AS (SELECT l_quantity AS f0, l_discount AS f1, l_tax AS f2, {_LINE_TEST} AS test,
                {fold('l_orderkey', 3)} AS fold,
                l_quantity * 10 + l_discount * 1000 + CASE WHEN l_quantity > 30 THEN 400 ELSE 0 END AS y
         FROM lineitem)"""


def stump_sql(k: str, fit: str, judge: str) -> str:
    """Common table expressions: ``rows``; ``best``: for each number in ``k`` the split of least squared
    error over the rows where ``fit`` holds; ``judged``: rmse and number of the rows where ``judge`` holds."""
    long = " UNION ALL ".join(f"SELECT k, {i} AS f, f{i} AS v, y FROM tr" for i in range(3))
    return f"""{_STUMP_ROWS},
ks AS (SELECT k FROM (VALUES {k}) t(k)),
tr AS (SELECT * FROM rows, ks WHERE {fit}),
g AS (SELECT k, f, v, count(*) AS n, sum(y) AS s FROM ({long}) GROUP BY k, f, v),
c AS (SELECT k, f, v, lead(v) OVER w AS nv, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
             sum(n) OVER p AS nt, sum(s) OVER p AS st
      FROM g WINDOW w AS (PARTITION BY k, f ORDER BY v), p AS (PARTITION BY k, f)),
cand AS (SELECT k, f, (v + nv) / 2 AS t, sl / nl AS below, (st - sl) / (nt - nl) AS above,
                sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS gain FROM c WHERE nv IS NOT NULL),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, t) = 1),
judged AS (SELECT best.k, sqrt(avg(power(y - CASE WHEN (CASE f WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END) <= t
                                              THEN below ELSE above END, 2))) AS rmse, count(*) AS n
           FROM rows, best WHERE {judge} GROUP BY best.k)"""


ORACLE["stump_regression"] = f"""
WITH {stump_sql("(0)", "NOT test", "test")}
SELECT CAST(f AS INTEGER) AS feature, round(t, 6) AS threshold, round(below, 4) AS below,
       round(above, 4) AS above, round(rmse, 4) AS rmse, n FROM best JOIN judged USING (k)"""
ORACLE["cv_fold_scores"] = f"""
WITH {stump_sql("(0), (1), (2)", "NOT test AND fold <> k", "NOT test AND fold = best.k")}
SELECT CAST(trees AS INTEGER) AS trees, CAST(k AS INTEGER) AS fold, 'rmse' AS metric,
       round(rmse, 4) AS value, n AS n_rows FROM judged, (VALUES (1), (2)) v(trees)"""
