"""DuckDB SQL fragments used to state each registered query independently.

These strings are the correctness oracle: they restate the semantics of a
job in plain SQL over the same driver tables, without sharing any code
path with the Spark implementation.
"""

from __future__ import annotations


def clean_sql(x: str) -> str:
    """The twelve-step cleaning chain as nested DuckDB calls."""
    s = f"trim(regexp_replace({x}, '[ \\t\\n]+', ' ', 'g'))"
    s = f"regexp_replace({s}, '[^\\x20-\\x7E]', '', 'g')"
    s = f"lower({s})"
    s = f"regexp_replace({s}, 'htt.*://[^ ]+', '', 'g')"
    s = f"regexp_replace({s}, '\\\\n', '', 'g')"
    s = f"translate({s}, '!:;?,=()#@%', '           ')"
    s = f"regexp_replace({s}, '[\\\\-]+', ' ', 'g')"
    s = f"regexp_replace({s}, '\\[.*\\]', '', 'g')"
    s = f"regexp_replace({s}, '.[0-9\\\\,]+', '', 'g')"
    s = f"translate({s}, '.\"/_', '    ')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"regexp_replace({s}, '^ ', '')"


CLEAN_DOCS = f"SELECT doc_id, lang, source, {clean_sql('text')} AS text FROM documents"


def with_clean(body: str) -> str:
    return f"WITH docs AS ({CLEAN_DOCS})\n{body}"


TFIDF_SCORES_CTE = """
toks AS (SELECT doc_id, unnest(regexp_split_to_array(text || chr(10), '\\s')) AS token FROM docs),
tf AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY doc_id, token),
dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
sc AS (
  SELECT tf.doc_id, tf.token, tf.tf, dfs.df, ln(nn.n / (1 + dfs.df)) AS idf,
         tf.tf * ln(nn.n / (1 + dfs.df)) AS tfidf
  FROM tf JOIN dfs USING (token) CROSS JOIN nn
  WHERE dfs.df >= CAST({lo} AS DOUBLE) * nn.n AND dfs.df <= CAST({hi} AS DOUBLE) * nn.n)
"""


def tfidf_keywords_sql(pct: float, max_kws=None, min_kws=None, lo=0.0, hi=1.0) -> str:
    cut = f"ceil(n_terms * CAST({pct!r} AS DOUBLE))"
    if max_kws is not None:
        cut = f"least({cut}, {int(max_kws)})"
    if min_kws is not None:
        cut = f"greatest({cut}, {int(min_kws)})"
    return f"""WITH docs AS ({CLEAN_DOCS}),
{TFIDF_SCORES_CTE.format(lo=repr(float(lo)), hi=repr(float(hi))).strip()},
ranked AS (
  SELECT doc_id, token, tfidf,
         row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 9) DESC, token) AS rnk,
         count(*) OVER (PARTITION BY doc_id) AS n_terms
  FROM sc)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(rnk AS BIGINT) AS rank, token,
       round(tfidf, 6) + 0.0 AS tfidf
FROM ranked WHERE rnk <= {cut}"""


# Windowed counts restated by brute force: every window start s, every
# offset pair a < b inside the window (no closed form involved).
NGRAM_CTE = """
ws AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM docs),
wn AS (SELECT doc_id, w, len(w) AS n FROM ws WHERE len(w) > 0),
starts AS (SELECT doc_id, w, n, unnest(range(0, greatest(n - 10, 0) + 1)) AS s FROM wn),
uni AS (SELECT tok AS token, count(*) AS n FROM (SELECT unnest(w[s + 1 : s + 10]) AS tok FROM starts) GROUP BY tok),
offs AS (SELECT a.range AS a, b.range AS b FROM range(10) a, range(10) b WHERE a.range < b.range),
bi AS (
  SELECT least(x, y) AS w1, greatest(x, y) AS w2, count(*) AS n FROM (
    SELECT w[s + a + 1] AS x, w[s + b + 1] AS y FROM starts, offs WHERE s + b < n)
  WHERE x <> y GROUP BY least(x, y), greatest(x, y))
"""

TOPICS_CTE = """
toks AS (SELECT lang, source, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS token FROM docs),
wc AS (SELECT 'lang' AS model, lang AS grp, token, count(*) AS c FROM toks GROUP BY lang, token
       UNION ALL SELECT 'source' AS model, source AS grp, token, count(*) AS c FROM toks GROUP BY source, token),
rk AS (SELECT *, row_number() OVER (PARTITION BY model, grp ORDER BY c DESC, token) AS r FROM wc),
ks AS (SELECT unnest([1, 4, 10]) AS k),
tg AS (SELECT model, k, grp, list(token ORDER BY r) AS words FROM rk JOIN ks ON r <= k GROUP BY model, k, grp),
topics AS (SELECT model || '_' || CAST(k AS VARCHAR) AS run, model, k,
                  CAST(dense_rank() OVER (PARTITION BY model, k ORDER BY grp) - 1 AS INTEGER) AS cluster, words FROM tg)
"""

PAIRS_CTE = """
tp AS (SELECT run, cluster, words, unnest(range(len(words))) AS i FROM topics),
pairs AS (SELECT run, cluster, i, j, words[i + 1] AS word1, words[j + 1] AS word2
          FROM (SELECT run, cluster, words, i, unnest(range(i + 1, len(words))) AS j FROM tp)),
tot AS (SELECT (SELECT CAST(sum(n) AS DOUBLE) FROM uni) AS us, (SELECT CAST(sum(n) AS DOUBLE) FROM bi) AS bs),
pp AS (
  SELECT p.run, p.cluster, p.i, p.j, p.word1, p.word2,
         coalesce(u1.n, 0) / tot.us AS p1, coalesce(u2.n, 0) / tot.us AS p2,
         coalesce(b.n, 0) / tot.bs AS pb
  FROM pairs p CROSS JOIN tot
  LEFT JOIN uni u1 ON u1.token = p.word1
  LEFT JOIN uni u2 ON u2.token = p.word2
  LEFT JOIN bi b ON b.w1 = least(p.word1, p.word2) AND b.w2 = greatest(p.word1, p.word2)),
pmi AS (SELECT run, cluster, i, j, word1, word2,
               CASE WHEN p1 * p2 = 0 OR pb = 0 THEN 0.0 ELSE ln(pb / (p1 * p2)) END AS pmi FROM pp),
coh AS (SELECT t.run, t.cluster, avg(p.pmi) AS mean, median(p.pmi) AS median
        FROM topics t LEFT JOIN pmi p ON p.run = t.run AND p.cluster = t.cluster GROUP BY t.run, t.cluster)
"""


def ctes(*parts: str) -> str:
    body = ",\n".join(p.strip() for p in parts)
    return f"WITH docs AS ({CLEAN_DOCS}),\n{body}\n"
