"""String column functions: cleaning, tokenising, speaker labels, HTML.

All functions take and return ``Column`` objects built from
``pyspark.sql.functions`` only, so they stay inside whole-stage codegen
and push through Catalyst like any other projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The cleaning chain must give the same text as the reference
# pipeline, so these patterns and character sets are kept as they are.
# Java regex syntax, written as Python raw strings.
# ---------------------------------------------------------------------------
SHELL_BLANKS = r"[ \t\n]+"              # shell word splitting (IFS)
NON_PRINTABLE = r"[^\x20-\x7E]"          # tr -c -d '[:print:]' in the C locale
URL_GREEDY = r"htt.*://[^ ]+"            # first "htt" .. end of the last URL
URL_NON_GREEDY = r"htt[^ ]*://[^ ]+"     # one URL at a time (param)
LITERAL_BACKSLASH_N = r"\\n"
PUNCT_TO_SPACE = "!:;?,=()#@%"
DASH_RUNS = r"[\\-]+"                    # hyphens or backslashes
BRACKETS_GREEDY = r"\[.*\]"              # first "[" .. last "]"
BRACKETS_NON_GREEDY = r"\[[^\]]*\]"      # one bracket pair at a time (param)
NUMBER_AND_CHAR_BEFORE = r".[0-9\\,]+"
SEPARATORS_TO_SPACE = '."/_'
WHITESPACE_RUNS = r"\s+"
ONE_LEADING_SPACE = r"^ "

# Python 2 byte-string whitespace: the reference's strip() / \s.
PY_WS = r"[ \t\n\r\f\x0B]"
PY_WS_CHARS = " \t\n\r\f\x0b"
# JavaScript String.prototype.trim() whitespace (caption reader): TAB, VT,
# FF, SP, NBSP, ZWNBSP, the Unicode space separators (Zs) and the line
# terminators LF, CR, LS, PS.
JS_WS_CHARS = ("\t\x0b\x0c \u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u202f\u205f\u3000\n\r\u2028\u2029")
# Speaker label: capitals, hyphens and blanks, then a colon.
SPEAKER_LABEL = r"^([A-Z\- \t\n\r\f\x0B]+):([^\n]*)$"
# Caption index line and time code line.
CAPTION_INDEX = r"^[0-9]+$"
CAPTION_TIMECODE = r"[0-9:,]+\s*-->\s*[0-9:,]+"


def clean_text(c: Column, ascii_only: bool = True, greedy_urls: bool = True,
               greedy_brackets: bool = True) -> Column:
    """The twelve-step cleaning chain (SCL-1..12), in its fixed order."""
    c = F.trim(F.regexp_replace(c, SHELL_BLANKS, " "))
    if ascii_only:
        c = F.regexp_replace(c, NON_PRINTABLE, "")
    c = F.lower(c)
    c = F.regexp_replace(c, URL_GREEDY if greedy_urls else URL_NON_GREEDY, "")
    c = F.regexp_replace(c, LITERAL_BACKSLASH_N, "")
    c = F.translate(c, PUNCT_TO_SPACE, " " * len(PUNCT_TO_SPACE))
    c = F.regexp_replace(c, DASH_RUNS, " ")
    c = F.regexp_replace(c, BRACKETS_GREEDY if greedy_brackets else BRACKETS_NON_GREEDY, "")
    c = F.regexp_replace(c, NUMBER_AND_CHAR_BEFORE, "")
    c = F.translate(c, SEPARATORS_TO_SPACE, " " * len(SEPARATORS_TO_SPACE))
    c = F.regexp_replace(c, WHITESPACE_RUNS, " ")
    return F.regexp_replace(c, ONE_LEADING_SPACE, "")


def tokens_with_empties(c: Column) -> Column:
    """SCL-13: split on every single whitespace char, empty tokens kept.

    The reference reads lines with their newline, so a newline is appended:
    every document then holds at least one empty token.
    """
    return F.split(F.concat(c, F.lit("\n")), r"\s", -1)


def tokens(c: Column) -> Column:
    """SCL-14: split on whitespace runs, empty tokens dropped."""
    return F.filter(F.split(c, r"\s+", -1), lambda t: t != F.lit(""))


def py_strip(c: Column) -> Column:
    """Python's str.strip() on byte strings: ASCII whitespace at both ends."""
    return F.btrim(c, F.lit(PY_WS_CHARS))


def js_trim(c: Column) -> Column:
    """JavaScript's String.prototype.trim()."""
    return F.btrim(c, F.lit(JS_WS_CHARS))


def speaker_of(line: Column) -> Column:
    """SCL-15 speaker part; null when the line carries no label."""
    return F.when(line.rlike(SPEAKER_LABEL), F.regexp_extract(line, SPEAKER_LABEL, 1))


def said_of(line: Column) -> Column:
    """SCL-15 text part: stripped text after the label, else the whole line."""
    return F.when(line.rlike(SPEAKER_LABEL),
                  py_strip(F.regexp_extract(line, SPEAKER_LABEL, 2))).otherwise(line)


def first_token(c: Column) -> Column:
    """SCL-17: first space-separated token of a line."""
    return F.element_at(F.split(c, " ", -1), 1)


def strip_prefix(c: Column, prefix: Column) -> Column:
    """SCL-18: drop a known prefix from a line."""
    return F.substring(c, F.length(prefix) + 1, F.length(c))


# ---------------------------------------------------------------------------
# HTML (SCL-23/24). The tag and entity rules of the chain.
# ---------------------------------------------------------------------------
HTML_DROP_BLOCKS = [r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>",
                    r"(?is)<head\b.*?</head>", r"(?s)<!--.*?-->"]
HTML_TAG = r"<[^>]*>"
HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                 ("&#39;", "'"), ("&apos;", "'")]
HTML_OTHER_ENTITY = r"&[a-zA-Z]+;|&#[0-9]+;"
HTML_AMP = "&amp;"
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"


def html_to_text(html: Column) -> Column:
    """SCL-23: HTML page to one line of plain text, built-ins only."""
    c = html
    for pat in HTML_DROP_BLOCKS:
        c = F.regexp_replace(c, pat, " ")
    c = F.regexp_replace(c, HTML_TAG, " ")
    for ent, rep in HTML_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(rep))
    c = F.regexp_replace(c, HTML_OTHER_ENTITY, " ")
    c = F.replace(c, F.lit(HTML_AMP), F.lit("&"))
    return F.trim(F.regexp_replace(c, WHITESPACE_RUNS, " "))


def html_paragraphs(html: Column, container: str = "article", attribute: str | None = None) -> Column:
    """SCL-24: the paragraph bodies of all containers of a page, in order.

    ``container`` is their tag; ``attribute`` (as written in the page, for
    example ``class="displaytext"``) narrows it.
    """
    narrow = rf"[^>]*\Q{attribute}\E" if attribute else ""
    containers = F.regexp_extract_all(html, F.lit(rf"(?is)<{container}\b{narrow}[^>]*>(.*?)</{container}>"), 1)
    return F.flatten(F.transform(containers, lambda c: F.regexp_extract_all(c, F.lit(PARAGRAPH), 1)))


def replace_first(c: Column, needle: str) -> Column:
    """Remove the first occurrence of ``needle`` (JavaScript string replace)."""
    head = F.substring_index(c, needle, 1)
    return F.concat(head, F.substring(c, F.length(head) + len(needle) + 1, F.length(c)))
