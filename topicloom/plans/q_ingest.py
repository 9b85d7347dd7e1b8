"""Registered queries: captions, speakers, HTML, title dates (JOB-1, 2b, 2c, 12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import dates as D
from topicloom.functions.text import clean_text, html_paragraphs, html_to_text
from topicloom.operators import captions as cap
from topicloom.operators import speakers as spk
from topicloom.operators.dates import date_titles
from topicloom.plans.derive import caption_lines, order_titles, transcript_lines
from topicloom.plans import sql as S
from topicloom.plans.registry import register
from topicloom.plans.tables import table

# --------------------------------------------------------------------------- SQL
JS_WS = r"[\t\n\x0B\f\r \x{00A0}\x{FEFF}\x{2028}\x{2029}\p{Zs}]"
PY_WS = r"[ \t\n\r\f\x0B]"
LABEL = r"^([A-Z\- \t\n\r\f\x0B]+):([^\n]*)$"

CAPTION_CTE = f"""WITH
parts AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS L,
                 unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
lines AS (
  SELECT file, 4 * k AS line_no, CAST(k + 1 AS VARCHAR) AS raw FROM parts UNION ALL
  SELECT file, 4 * k + 1, printf('00:%02d:%02d,000 --> 00:%02d:%02d,900', (k // 60) % 60, k % 60,
                                 (k // 60) % 60, k % 60) FROM parts UNION ALL
  SELECT file, 4 * k + 2, L FROM parts UNION ALL
  SELECT file, 4 * k + 3, '' FROM parts),
t AS (SELECT file, line_no, raw, regexp_replace(raw, '^{JS_WS}+|{JS_WS}+\\z', '', 'g') AS trimmed FROM lines),
kept AS (
  SELECT c.file, c.line_no, c.trimmed || ' ' AS text FROM t c
  WHERE NOT EXISTS (SELECT 1 FROM t h WHERE h.file = c.file AND h.raw = c.trimmed
                    AND h.line_no < c.line_no AND h.line_no >= c.line_no - 20)
    AND NOT regexp_matches(c.trimmed, '^[0-9]+$')
    AND NOT regexp_matches(c.trimmed, '[0-9:,]+\\s*-->\\s*[0-9:,]+'))
"""

SPEAKER_CTE = f"""WITH
tl AS (SELECT conv_id AS file, turn, unnest(string_split(upper(role) || ': ' || text, chr(10))) AS line,
              unnest(range(len(string_split(upper(role) || ': ' || text, chr(10))))) AS sub FROM conversations),
s AS (SELECT file, turn, sub, regexp_replace(line, '^{PY_WS}+|{PY_WS}+\\z', '', 'g') AS line FROM tl),
s2 AS (SELECT file, turn, sub,
              CASE WHEN regexp_matches(line, '{LABEL}') THEN regexp_extract(line, '{LABEL}', 1) END AS label,
              CASE WHEN regexp_matches(line, '{LABEL}')
                   THEN regexp_replace(regexp_extract(line, '{LABEL}', 2), '^{PY_WS}+|{PY_WS}+\\z', '', 'g')
                   ELSE line END AS said
       FROM s WHERE line <> ''),
f AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY file ORDER BY turn, sub
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS speaker FROM s2),
st AS (SELECT file, speaker, regexp_replace(string_agg(said, ' ' ORDER BY turn, sub), '{PY_WS}+', ' ', 'g') AS text
       FROM f WHERE speaker IS NOT NULL GROUP BY file, speaker)
"""

HTML_TEXT_SQL = r"""trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x},
    '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'),
    '(?is)<head\b.*?</head>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''),
  '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g'))"""


def _html_text_sql(x: str) -> str:
    return HTML_TEXT_SQL.replace("{x}", x)


def _lp(x: str) -> str:
    return f"(CASE WHEN length({x}) < 2 THEN lpad({x}, 2, '0') ELSE {x} END)"


def _title_date_sql(title: str) -> str:
    pat = r"([0-9]+)[^\n]([0-9]+)[^\n]([0-9]+)"
    ts = f"regexp_replace({title}, '^{PY_WS}+|{PY_WS}+\\z', '', 'g')"
    mo, da, yr = (f"regexp_extract({ts}, '{pat}', {i})" for i in (1, 2, 3))
    y = f"(CASE WHEN length({yr}) = 2 THEN '20' || {yr} ELSE {yr} END)"
    swap = f"TRY_CAST({mo} AS DECIMAL(38,0)) > 12"
    m2 = f"(CASE WHEN {swap} THEN {da} ELSE {mo} END)"
    d2 = f"(CASE WHEN {swap} THEN {mo} ELSE {da} END)"
    return (f"(CASE WHEN regexp_matches({ts}, '{pat}') AND TRY_CAST({y} AS DECIMAL(38,0)) >= 2014 "
            f"THEN {y} || '-' || {_lp(m2)} || '-' || {_lp(d2)} END)")


def _date_sql(ymd: str) -> str:
    return (f"CAST(CASE WHEN regexp_matches({ymd}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') "
            f"THEN TRY_CAST({ymd} AS DATE) END AS VARCHAR)")


ORDER_TITLES_CTE = """
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d0, CAST(o_orderdate AS DATE) + INTERVAL 22 YEAR AS d FROM orders),
ot AS (SELECT o_orderkey, d0, CAST(d AS DATE) AS shifted,
  CASE o_orderkey % 4
    WHEN 0 THEN 'Rally in Town (' || month(d) || '-' || day(d) || '-' || lpad(CAST(year(d) % 100 AS VARCHAR), 2, '0') || ')'
    WHEN 1 THEN 'Speech ' || day(d) || '.' || month(d) || '.' || year(d)
    WHEN 2 THEN '10,000 Plus (' || month(d) || '-' || day(d) || '-' || lpad(CAST(year(d) % 100 AS VARCHAR), 2, '0') || ')'
    ELSE 'Event ' || month(d0) || '/' || day(d0) || '/' || year(d0) END AS title,
  CAST(month(d) AS VARCHAR) AS month, CAST(day(d) AS VARCHAR) AS day, CAST(year(d) AS VARCHAR) AS year FROM o)
"""

# ----------------------------------------------------------------------- queries


@register("caption_dedup", sql=CAPTION_CTE + """
SELECT CAST(file AS BIGINT) AS file, CAST(line_no AS BIGINT) AS line_no, text FROM kept""")
def q_caption_dedup(spark, sf_dir):
    k = cap.dedup_caption_lines(caption_lines(spark, sf_dir))
    return k.select(F.col("file").cast("bigint"), F.col("line_no").cast("bigint"), "text")


@register("caption_text", sql=CAPTION_CTE + """
SELECT CAST(file AS BIGINT) AS file, string_agg(text, '' ORDER BY line_no) AS text FROM kept GROUP BY file""")
def q_caption_text(spark, sf_dir):
    return cap.captions_to_documents(caption_lines(spark, sf_dir)).select(F.col("file").cast("bigint"), "text")


def _turn_block():
    """A turn, and 1,024 lines of it: neither a long turn nor a long transcript is one group."""
    return F.struct(F.col("turn"), F.floor(F.col("sub") / F.lit(1024)).alias("part"))


def _speaker_lines(spark, sf_dir):
    return spk.speaker_lines(transcript_lines(spark, sf_dir), order=("turn", "sub"),
                             block=_turn_block())


@register("speaker_lines", sql=SPEAKER_CTE + """
SELECT CAST(file AS BIGINT) AS file, CAST(turn AS BIGINT) AS turn, CAST(sub AS BIGINT) AS sub, speaker, said
FROM f WHERE speaker IS NOT NULL""")
def q_speaker_lines(spark, sf_dir):
    s = _speaker_lines(spark, sf_dir)
    return s.select(F.col("file").cast("bigint"), F.col("turn").cast("bigint"), F.col("sub").cast("bigint"),
                    "speaker", "said")


def _speaker_text(spark, sf_dir):
    return spk.speaker_text(transcript_lines(spark, sf_dir), order=("turn", "sub"), sep=" ",
                            block=_turn_block())


@register("speaker_text", sql=SPEAKER_CTE + "SELECT CAST(file AS BIGINT) AS file, speaker, text FROM st")
def q_speaker_text(spark, sf_dir):
    return _speaker_text(spark, sf_dir).select(F.col("file").cast("bigint"), "speaker", "text")


@register("speaker_corpus", sql=SPEAKER_CTE + f""",
sc AS (SELECT speaker, regexp_replace(string_agg(said, ' ' ORDER BY file, turn, sub), '{PY_WS}+', ' ', 'g') AS text
       FROM f WHERE speaker IS NOT NULL GROUP BY speaker)
SELECT speaker, {S.clean_sql('text')} AS text FROM sc""")
def q_speaker_corpus(spark, sf_dir):
    """JOB-2b to its end: one cleaned document per speaker over all files."""
    c = spk.speaker_corpus(transcript_lines(spark, sf_dir), order=("turn", "sub"), block=_turn_block())
    return c.select("speaker", clean_text(F.col("text")).alias("text"))


@register("speaker_prefix_join", sql=SPEAKER_CTE + """,
ln AS (SELECT file, speaker || ' ' || text AS line FROM st),
lab AS (SELECT DISTINCT speaker FROM st)
SELECT CAST(ln.file AS BIGINT) AS file, lab.speaker, substr(ln.line, length(lab.speaker) + 1) AS rest
FROM ln JOIN lab ON starts_with(ln.line, lab.speaker)""")
def q_speaker_prefix_join(spark, sf_dir):
    st = _speaker_text(spark, sf_dir)
    lines = st.select("file", F.concat_ws(" ", "speaker", "text").alias("line"))
    j = spk.prefix_join(lines, spk.speakers(st))
    return j.select(F.col("file").cast("bigint"), "speaker", "rest")


@register("html_text", sql=f"SELECT CAST(page_id AS BIGINT) AS page_id, {_html_text_sql('html')} AS text FROM pages")
def q_html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("bigint"), html_to_text(F.col("html")).alias("text"))


@register("html_paragraphs", sql=f"""
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(i AS BIGINT) AS para_no, {_html_text_sql('para')} AS text FROM (
  SELECT page_id, unnest(ps) AS para, unnest(range(len(ps))) AS i FROM (
    SELECT page_id, flatten(list_transform(regexp_extract_all(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1),
                                           lambda c: regexp_extract_all(c, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1))) AS ps FROM pages))""")
def q_html_paragraphs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    x = p.select("page_id", F.posexplode(html_paragraphs(F.col("html"))).alias("i", "para"))
    return x.select(F.col("page_id").cast("bigint"), F.col("i").cast("bigint").alias("para_no"),
                    html_to_text(F.col("para")).alias("text"))


@register("title_dates", sql=f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, {_title_date_sql('text')} AS ymd,
       {_date_sql(_title_date_sql('text'))} AS date FROM documents""")
def q_title_dates(spark, sf_dir):
    d = D.with_title_date(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return d.select(F.col("doc_id").cast("bigint"), "ymd", F.col("date").cast("string"))


@register("title_dates_orders", sql=f"WITH {ORDER_TITLES_CTE.strip()}" + f"""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, title, {_title_date_sql('title')} AS ymd,
       {_date_sql(_title_date_sql('title'))} AS date FROM ot""")
def q_title_dates_orders(spark, sf_dir):
    t = D.with_title_date(order_titles(spark, sf_dir).select("o_orderkey", "title"), "title")
    return t.select(F.col("o_orderkey").cast("bigint"), "title", "ymd", F.col("date").cast("string"))


def _overrides(t):
    """Override rows for the '10,000 Plus' titles: a wrong (day, month) entry
    first and the right one after it, so the later entry must win."""
    src = t.filter(F.col("title").startswith("10,000 Plus"))
    wrong = src.select("title", F.col("day").alias("month"), F.col("month").alias("day"), "year",
                       F.lit(0).alias("seq"))
    right = src.select("title", "month", "day", "year", F.lit(1).alias("seq"))
    return wrong.unionByName(right)


@register("title_dates_override", sql=f"WITH {ORDER_TITLES_CTE.strip()}," + f"""
ov AS (SELECT title, day AS month, month AS day, year, 0 AS seq FROM ot WHERE starts_with(title, '10,000 Plus')
       UNION ALL SELECT title, month, day, year, 1 AS seq FROM ot WHERE starts_with(title, '10,000 Plus')),
ovl AS (SELECT title, arg_max(month, seq) AS month, arg_max(day, seq) AS day, arg_max(year, seq) AS year
        FROM ov GROUP BY title),
r AS (SELECT ot.o_orderkey, ot.title,
             CASE WHEN ovl.title IS NOT NULL THEN
               (CASE WHEN length(ovl.year) = 2 THEN '20' || ovl.year ELSE ovl.year END)
             END AS oy, ovl.month AS om, ovl.day AS od FROM ot LEFT JOIN ovl ON ot.title = ovl.title),
r2 AS (SELECT o_orderkey, title,
              CASE WHEN oy IS NULL THEN {_title_date_sql('title')}
                   WHEN TRY_CAST(oy AS DECIMAL(38,0)) >= 2014 THEN
                     oy || '-' || {_lp(f"(CASE WHEN TRY_CAST(om AS DECIMAL(38,0)) > 12 THEN od ELSE om END)")}
                        || '-' || {_lp(f"(CASE WHEN TRY_CAST(om AS DECIMAL(38,0)) > 12 THEN om ELSE od END)")}
              END AS ymd FROM r)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, ymd, {_date_sql('ymd')} AS date FROM r2""")
def q_title_dates_override(spark, sf_dir):
    t = order_titles(spark, sf_dir)
    out = date_titles(t.select("o_orderkey", "title"), _overrides(t))
    return out.select(F.col("o_orderkey").cast("bigint"), "ymd", F.col("date").cast("string"))


ORDINAL_SQL = r"""
od AS (SELECT o_orderkey, shifted, strftime(shifted, '%B') || ' ' || day(shifted) ||
          CASE WHEN day(shifted) IN (1, 21, 31) THEN 'st' WHEN day(shifted) IN (2, 22) THEN 'nd'
               WHEN day(shifted) IN (3, 23) THEN 'rd' ELSE 'th' END || ', ' || year(shifted) AS text FROM ot)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, text,
       CAST(CAST(try_strptime(regexp_replace(text, '^(.*) ([0-9]+)(st|nd|rd|th), (.*)$', '\1 \2 \4'), '%B %d %Y') AS DATE)
            AS VARCHAR) AS date
FROM od"""


@register("ordinal_dates", sql=f"WITH {ORDER_TITLES_CTE.strip()}," + ORDINAL_SQL)
def q_ordinal_dates(spark, sf_dir):
    t = order_titles(spark, sf_dir)
    dd = F.dayofmonth("shifted")
    suffix = (F.when(dd.isin(1, 21, 31), "st").when(dd.isin(2, 22), "nd")
              .when(dd.isin(3, 23), "rd").otherwise("th"))
    text = F.concat(F.date_format("shifted", "MMMM"), F.lit(" "), dd.cast("string"), suffix,
                    F.lit(", "), F.year("shifted").cast("string"))
    x = t.select("o_orderkey", text.alias("text"))
    return x.select(F.col("o_orderkey").cast("bigint"), "text",
                    D.ordinal_to_date(F.col("text")).cast("string").alias("date"))


@register("reorder_dates", sql="""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, strftime(CAST(o_orderdate AS DATE), '%m-%d-%Y') AS mdy FROM orders""")
def q_reorder_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ymd = F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd")
    return o.select(F.col("o_orderkey").cast("bigint"), D.ymd_to_mdy(ymd).alias("mdy"))


@register("file_dates", sql=f"WITH {ORDER_TITLES_CTE.strip()}" + r"""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey,
  CASE WHEN regexp_matches(title, '^[^\n]*[( ]([0-9]+)[^\n]([0-9]+)[^\n]([0-9]+)[^\n]*$')
       THEN concat_ws(' ', regexp_extract(title, '^[^\n]*[( ]([0-9]+)[^\n]([0-9]+)[^\n]([0-9]+)[^\n]*$', 1),
                           regexp_extract(title, '^[^\n]*[( ]([0-9]+)[^\n]([0-9]+)[^\n]([0-9]+)[^\n]*$', 2),
                           regexp_extract(title, '^[^\n]*[( ]([0-9]+)[^\n]([0-9]+)[^\n]([0-9]+)[^\n]*$', 3))
       ELSE title END AS mdy
FROM ot WHERE regexp_matches(title, '[0-9]+[^\n][0-9]+[^\n][0-9]+') AND NOT contains(title, '.en.')""")
def q_file_dates(spark, sf_dir):
    t = order_titles(spark, sf_dir)
    t = t.filter(F.col("title").rlike(r"[0-9]+[^\n][0-9]+[^\n][0-9]+") & ~F.col("title").contains(".en."))
    return t.select(F.col("o_orderkey").cast("bigint"), D.file_name_date(F.col("title")).alias("mdy"))


@register("html_documents", sql=f"""
SELECT CAST(page_id AS BIGINT) AS page_id, {S.clean_sql(_html_text_sql('html'))} AS text FROM pages""")
def q_html_documents(spark, sf_dir):
    """JOB-2c end to end: pages -> plain text -> the cleaning chain (one document per page)."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("bigint"), clean_text(html_to_text(F.col("html"))).alias("text"))
