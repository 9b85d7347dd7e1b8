"""Operator 4: main text of pages by a site style tree.

The DOMs of one host are merged: an element node is known by its place (the
style of its parent, its position there, tag and attributes), and keeps the
styles (sequences of children) and leaf contents that pages showed in it.
Importance, for a node E on m pages with l styles S of page shares p:

    NodeImp(E) = -sum p log_m p                       (1 where m = 1)
    Content(S) = 1 - mean over its distinct contents of log_m(pages with it)
    Imp(E) = (1 - decay**l) NodeImp(E) + decay**l sum p Comp(S)

with Comp(S) the mean Imp of its children, or Content(S) of a leaf. Varied
layout or varied text makes a branch important, what a site repeats does
not. Nodes under ``threshold`` on at least ``min_pages`` pages are cut with
all below them. Equal pages of a host count once.

Markup that states its role adds to the tree: elements, classes and roles of
menus, footers, adverts and the like go even where a host has too few pages
to tell, unless they hold the main part with half of the page's text, or
nine tenths of the text of the page or main part. A page has no other main
part than its main element, or its articles where these hold at least half
of what is important; any other page keeps all that is important. Inside article or main the tree cuts too, nodes on
at least the share ``wide`` of the host's pages; where such nodes hold more
than half of a page's main text they are its body, and stay.

Runs of equal siblings count as one in a style, and a child is placed by its
run and its number there, so what follows a varying number of paragraphs is
one node on all pages.

The tree is made of counted rows (host, node, style, content), aggregated
map-side, and importance runs up from the deepest level; no task holds a
host. Elements deeper than ``depth`` are nodes too, all on its level, each
weighed by its own content alone.

Few pages are little evidence: on m pages the threshold is its share
(1 - 1/m), and of a host with m pages no page loses more than that share of
its text to the tree; if it would, the tree cuts nothing there.

Defined cases: null html is empty, null url is the host ''; a page's text is
the empty string if nothing is left; broken markup is read as browsers do
(unclosed elements, unquoted attributes, a tag cut off at the end); one row
per row, repeated or null ids included; an empty table gives no rows; other
columns are left alone.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import Tables, written


@dataclass(frozen=True)
class Pruning:
    threshold: float = 0.25
    min_pages: int = 8
    decay: float = 0.9
    depth: int = 12
    wide: float = 0.5


#: For sites of any size; the default leaves hosts of few pages alone.
ALL_HOSTS = Pruning(min_pages=2)

# Roles that markup states.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead title tr ul""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul""".split())
#: An opening tag ends these, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
MAIN = frozenset("article main".split())
NOISE_TAGS = frozenset("""head nav footer aside form script style noscript template iframe object svg canvas button select input
textarea dialog menu audio video map""".split())
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
consent cookie cookies disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination
popup promo promotion promoted related respond search share sharing sidebar signup skip social sponsor sponsored subscribe
toolbar widget contentinfo complementary alert""".split())
#: Roles only outside the main part, where they may hold its title.
OUTER_WORDS = frozenset("header top topbar".split())

_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Page:
    """Elements in page order (number 0 is the page) and the run of texts and breaks."""

    def __init__(self, source: str):
        self.tag, self.mark, self.words, self.parent, self.children = [""], [""], [frozenset()], [-1], [[]]
        self.hidden = [False]
        self.runs: list[tuple[int, str | None]] = []
        self.among: dict[tuple[int, int], list[str]] = {}
        self._roles = None
        stack, at = [0], 0
        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue  # inside raw text
            if m.start() > at:
                self._text(stack[-1], source[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(stack, name)
                continue
            self._open(stack, name, m[3] or m[6] or "")
            if name in RAW:
                end = _END[name].search(source, at)
                at = end.start() if end else len(source)
        if at < len(source):
            self._text(stack[-1], source[at:])

    def _text(self, node: int, raw: str):
        if self.tag[node] in RAW:
            return
        self.runs.append((node, html.unescape(raw)))
        if raw.strip():
            if not self.children[node] or self.children[node][-1] >= 0:
                self.children[node].append(-1)  # text among the children
            self.among.setdefault((node, len(self.children[node]) - 1), []).append(self.runs[-1][1])

    def _pop(self, stack: list[int], to: int):
        while len(stack) > to:
            node = stack.pop()
            if self.tag[node] in BLOCK:
                self.runs.append((node, None))

    def _close(self, stack: list[int], name: str):
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                return self._pop(stack, k)
            # an inline end tag doesn't reach beyond its block
            if name not in BLOCK and self.tag[stack[k]] in BLOCK:
                return None
        return None

    def _open(self, stack: list[int], name: str, raw: str):
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] == "p":
                    self._pop(stack, k)
                    break
                if self.tag[stack[k]] in BLOCK:
                    break
        if name in ENDS:
            ended, border = ENDS[name]
            low = None
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in ended:
                    low = k
                if self.tag[stack[k]] in border:
                    break
            if low:
                self._pop(stack, low)
        mark, words, hidden = "", frozenset(), False
        if raw and not raw.isspace():
            found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}
            mark = " ".join(f"{k}={found[k]}" for k in ("class", "id", "role") if k in found)
            words = frozenset(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", mark.partition("=")[2]).lower())) if mark else words
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        if name in BLOCK:
            self.runs.append((stack[-1], None))
        elif name == "br":
            self.runs.append((stack[-1], " "))
        number = len(self.tag)
        self.tag.append(name)
        self.mark.append(mark)
        self.words.append(words)
        self.hidden.append(hidden)
        self.parent.append(stack[-1])
        self.children.append([])
        self.children[stack[-1]].append(number)
        if name not in VOID and not (raw.endswith("/") and name == "svg"):
            stack.append(number)

    def roles(self) -> tuple[list[bool], list[bool], bool]:
        """(noise by markup, inside a main part, <main> or its role states one) per element."""
        if self._roles:
            return self._roles
        named = [t in MAIN or ("main" in w and "role=main" in m) for t, w, m in zip(self.tag, self.words, self.mark)]
        sizes, holds = [0] * len(self.tag), [False] * len(self.tag)
        for node, text in self.runs:
            sizes[node] += len("".join((text or "").split()))
        for k in range(len(self.tag) - 1, 0, -1):
            if self.hidden[k] or (self.tag[k] in NOISE_TAGS and self.tag[k] != "form"):
                sizes[k] = 0  # noise whatever it holds
            sizes[self.parent[k]] += sizes[k]
            holds[self.parent[k]] |= holds[k] or named[k]
        noise, main, root, stated = [False], [False], [0], False
        for k in range(1, len(self.tag)):
            up = self.parent[k]
            root.append(k if named[k] and not main[up] else root[up])
            name = self.tag[k] == "form" or bool(self.words[k] & NOISE_WORDS) or (not main[up] and bool(self.words[k] & OUTER_WORDS))
            # a name says nothing of what holds the main part, or nearly all there is
            name = name and not ((holds[k] and sizes[k] * 2 >= sizes[0]) or sizes[k] * 10 >= sizes[root[up]] * 9 > 0)
            own = name or self.hidden[k] or (self.tag[k] in NOISE_TAGS and self.tag[k] != "form")
            own = own or (not main[up] and self.tag[k] == "header")
            # html and body hold the page whatever their classes say
            own = own and self.tag[k] not in ("html", "body") and not (self.tag[k] in MAIN and not main[up])
            noise.append(noise[up] or own)
            main.append((main[up] or named[k]) and not noise[k])
            stated |= main[k] and named[k] and self.tag[k] != "article" and sizes[k] > 0
        self._roles = noise, main, stated
        return self._roles

    def contents(self) -> list[str]:
        """The text below each element."""
        own: list[list[str]] = [[] for _ in self.tag]
        for node, text in self.runs:
            if text:
                own[node].append(text)
        out = [""] * len(self.tag)
        for k in range(len(self.tag) - 1, -1, -1):
            parts = " ".join([*own[k], *(out[c] for c in self.children[k] if c > 0)])
            out[k] = " ".join(parts.split())
        return out

    def nodes(self, depth: int, contents: bool = True) -> list[tuple[int, dict]]:
        """(element, row) of the style tree: all elements, those at the depth
        limit and each one below it as a leaf. Text among children is a leaf too; what holds no text
        has no importance to give and no row."""
        content = self.contents() if contents else None
        out, todo = [], [(0, 0, 0, 0, 0, None)]
        while todo:
            node, parent, pstyle, place, level, among = todo.pop()
            if node < 0:
                key, own = _hash(parent, pstyle, place, "#text"), _hash(" ".join("".join(self.among[among]).split())) if contents else None
                out.append((node, {"key": key, "parent": parent, "pstyle": pstyle, "style": 0, "content": own, "depth": level}))
                continue
            if contents and not content[node]:
                continue
            key = _hash(parent, pstyle, place, self.tag[node], self.mark[node])
            below = self.children[node]
            inner = any(c > 0 for c in below)
            leaf = level >= depth or not inner
            names = ["#text" if c < 0 else f"{self.tag[c]} {self.mark[c]}" for c in below]
            style = _hash(*(n for k, n in enumerate(names) if not k or n != names[k - 1])) or 1
            out.append((node, {"key": key, "parent": parent, "pstyle": pstyle, "style": 0 if leaf else style,
                               "content": _hash(content[node]) if leaf and contents else None, "depth": level}))
            if inner:
                run = at = 0
                for k, c in enumerate(below):
                    run, at = (run, at + 1) if k and names[k] == names[k - 1] else (run + 1, 0)
                    if c > 0 or not leaf:
                        todo.append((c, key, style, f"{run}.{at}", min(level + 1, depth), (node, k)))
        return out

    def text(self, cut: set[int], wide: set[int] = frozenset(), of: int | None = None) -> str:
        """The text without noise and without the elements in ``cut``: blocks joined by line ends.
        ``of``: pages of the host, which bound what may go.
        Inside main parts only those also in ``wide`` go, and only if most of the main text stays."""
        noise, main, stated = self.roles()
        low, inside = [False], [False]
        for k in range(1, len(self.tag)):
            up = self.parent[k]
            low.append(low[up] or (k in cut and not main[k] and not self._holds_main(k, main)))
            inside.append(inside[up] or (k in wide and main[k] and main[up]))
        sizes, outside, lowly = [0, 0], 0, 0
        for node, text in self.runs:
            if text and not noise[node]:
                size = len("".join(text.split()))
                if low[node]:
                    lowly += size
                elif main[node]:
                    sizes[inside[node]] += size
                else:
                    outside += size
        if of and lowly * of > (lowly + sum(sizes) + outside) * (of - 1):
            return self.text(set(), {k for k in wide if main[k]}, of)
        # articles that hold less than what is important beside them are cards, not the main part
        marked = stated or (sum(sizes) > 0 and sum(sizes) >= outside)
        gone = [a or (b and sizes[1] <= sizes[0]) for a, b in zip(low, inside)]
        blocks, own = [], []
        for node, text in self.runs:
            if text is None:
                blocks.append(" ".join("".join(own).split()))
                own = []
            elif not noise[node] and not gone[node] and (main[node] or not marked):
                own.append(text)
        blocks.append(" ".join("".join(own).split()))
        return "\n".join(b for b in blocks if b)

    def _holds_main(self, node: int, main: list[bool]) -> bool:
        if not hasattr(self, "holders"):
            self.holders = set()
            for k, inside in enumerate(main):
                while inside and k not in self.holders and k >= 0:
                    self.holders.add(k)
                    k = self.parent[k]
        return node in self.holders


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


#: The node that every page has: the page itself.
ROOT = _hash(0, 0, 0, "", "")
NODE = pa.struct([("key", pa.int64()), ("parent", pa.int64()), ("pstyle", pa.int64()), ("style", pa.int64()),
                  ("content", pa.int64()), ("depth", pa.int32())])


def page_nodes(depth: int):
    @arrow_udf("array<struct<key:bigint,parent:bigint,pstyle:bigint,style:bigint,content:bigint,depth:int>>")
    def nodes(pages: pa.Array) -> pa.Array:
        return pa.array([[row for _, row in Page(p.as_py() or "").nodes(depth)] for p in pages], pa.list_(NODE))
    return nodes


def page_text(depth: int):
    @arrow_udf("string")
    def text(pages: pa.Array, cut: pa.Array, of: pa.Array) -> pa.Array:
        out = []
        for source, keys, n in zip(pages, cut, of):
            page = Page(source.as_py() or "")
            keys = {k["key"]: k["wide"] for k in keys.as_py() or ()}
            low = {k: keys[row["key"]] for k, row in page.nodes(depth, False) if row["key"] in keys} if keys else {}
            out.append(page.text(set(low), {k for k, wide in low.items() if wide}, n.as_py()))
        return pa.array(out, pa.string())
    return text


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def importance(nodes: DataFrame, p: Pruning, written) -> DataFrame:
    """(host, key, pages, importance) of every node, from rows (host, key, parent, pstyle, style, content, depth)."""
    node = ["host", "key", "parent", "pstyle", "depth"]
    kinds = nodes.groupBy(*node, "style", "content").agg(F.count("*").alias("n"))
    styles = written(kinds.groupBy(*node, "style").agg(F.sum("n").alias("n"), F.count("*").alias("contents"),
                                                       F.sum(F.log("n")).alias("logs")), "styles")
    deepest = styles.agg(F.max("depth").alias("d")).first()["d"]
    below, levels = None, []
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = styles.filter(F.col("depth") == depth)
        leaf = F.when(F.col("n") > 1, 1 - F.col("logs") / (F.col("contents") * F.log("n"))).otherwise(1.0)
        comp = F.when(F.col("style") == 0, leaf)
        if below is not None:
            here = here.join(below, (here.host == below._host) & (here.key == below._key) & (here.style == below._style), "left")
            comp = comp.otherwise(F.coalesce("below", F.lit(1.0)))
        pages, kind = F.sum("n"), F.count("*")
        own = here.withColumn("comp", F.coalesce(comp, F.lit(1.0))).groupBy(*node).agg(
            pages.alias("pages"), kind.alias("l"), F.sum(F.col("n") * F.log("n")).alias("nlogs"),
            F.sum(F.col("n") * F.col("comp")).alias("comps"))
        varied = F.when(F.col("pages") > 1, 1 - F.col("nlogs") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
        weight = F.pow(F.lit(p.decay), F.col("l"))
        own = own.select("host", "key", "parent", "pstyle", "pages", ((1 - weight) * varied + weight * F.col("comps") / F.col("pages"))
                         .alias("importance"))
        levels.append(written(own, f"level{depth}"))
        below = levels[-1].groupBy(F.col("host").alias("_host"), F.col("parent").alias("_key"), F.col("pstyle").alias("_style")).agg(
            F.avg("importance").alias("below"))
    if not levels:
        return styles.select("host", "key", F.col("n").alias("pages"), F.lit(1.0).alias("importance"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("host", "key", "pages", "importance")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              p: Pruning = Pruning()) -> DataFrame:
    """page_id, url, text, n_chars per row."""
    with Tables() as tables:
        page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                            F.coalesce(F.col(html_col), F.lit("")).alias("html"))
        page = page.withColumn("page", F.md5(F.encode("html", "UTF-8")))
        seen = tables.written(page.select("host", "page", page_nodes(p.depth)("html").alias("nodes"))
                              .dropDuplicates(["host", "page"]).select("host", "page", F.explode("nodes").alias("n"))
                              .select("host", "page", "n.*"), "nodes")
        weighed = importance(seen.drop("page"), p, tables.written)
        hosts = weighed.filter(F.col("key") == ROOT).select("host", F.col("pages").alias("of"))
        evidence = p.threshold * (1 - 1 / F.col("pages"))
        low = weighed.filter((F.col("pages") >= p.min_pages) & (F.col("importance") < evidence)).join(hosts, "host")
        low = tables.written(low.select("host", "key", "of", (F.col("pages") >= p.wide * F.col("of")).alias("wide")), "low")
        cut = (seen.select("host", "page", "key").join(low, ["host", "key"])
               .groupBy(F.col("host").alias("_host"), F.col("page").alias("_page"))
               .agg(F.collect_list(F.struct("key", "wide")).alias("cut"), F.first("of").alias("of")))
        cut = written(cut, "cut")
    out = page.join(cut, (F.col("host") == F.col("_host")) & (F.col("page") == F.col("_page")), "left")
    out = out.select("page_id", "url", page_text(p.depth)("html", "cut", "of").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
