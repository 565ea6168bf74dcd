"""DuckDB SQL for the registered queries that SQL can express."""

_HOST_PATH = """
split AS (
  SELECT page_id,
         CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0
              THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, rest,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1),
                                 '^[^?#]*'), '') AS path
  FROM split)"""

OP2 = f"""
WITH {_HOST_PATH},
rules(rhost, rpath, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
         max_by(r.verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost))
                         AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN p.host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
pat AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, w[i:i + least(10, len(w)) - 1] AS p
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, i, m, w[i:i + m - 1] AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
hit AS (SELECT pos.doc_id, pos.i, pos.m, pat.item FROM pos JOIN pat USING (m, p)),
words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit,
       coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT x, min(doc_id) AS least FROM win GROUP BY x),
hit AS (SELECT win.doc_id, i FROM win JOIN firsts USING (x) WHERE least < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM hit),
word AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY k) AS t
         FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
h AS (SELECT *, CAST(('0x' || x[1:8]) AS UBIGINT) % (n + 1) AS c1,
             CAST(('0x' || x[9:16]) AS UBIGINT) % (n + 1) AS c2,
             CAST(('0x' || x[17:24]) AS UBIGINT) % 100 AS r3,
             CAST(('0x' || x[25:32]) AS UBIGINT) % 100 AS r4 FROM d),
f AS (SELECT doc_id, n, t, CAST(least(c1, c2) AS BIGINT) AS lo, CAST(greatest(c1, c2) AS BIGINT) AS hi,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                       OR r3 >= 90 THEN 'plain' WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form
      FROM h),
p AS (SELECT *, substring(t, 1, lo) AS pre, substring(t, lo + 1, hi - lo) AS mid,
             substring(t, hi + 1) AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
              WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

ORACLE: dict[str, str] = {"op2_url_trie": OP2, "op9_decontaminate": OP9,
                          "op11_substring_dedup": OP11, "op12_fill_in_middle": OP12}
