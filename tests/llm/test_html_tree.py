"""Operator 4: markup rules, importance against the paper's recursion, and the defined cases."""

import math
import random
from collections import Counter, defaultdict

from topicloom.llm import html_tree as ht

SCHEMA = "page_id bigint, url string, html string, host string, cut int, text string"


def text(html):
    return ht.Page(html).text(set())


def test_blocks_and_references():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu">
    <header>Site</header><nav><ul><li>Home</ul></nav><!-- <p>no</p> --><div class='ad box'>Buy</div>
    <article><header><h1>A &amp; B</h1></header><p><b>one<br>two <i>three</i><p>four&nbsp;&#x41;&eacute;
    <ul><li>x<li>y <em>z</em></ul><table><tr><td>1<td>2<tr><td>3</table><form><input value=q>Send</form>
    <p>a &lt; b &copy 5 < 6<div id="comments">I disagree</div><aside>See also</aside><p hidden>secret</p><footer>by me</footer>
    <pre>k
      l</pre></article><p>outside</p><footer>&copy;</footer></body></html> tail"""
    assert text(page) == "A & B\none two three\nfour Aé\nx\ny z\n1\n2\n3\na < b © 5 < 6\nk l"


def test_pages_without_a_main_part_and_broken_markup():
    assert text("<body><nav>menu</nav><div class=content><p>one<p>two</div><footer>f") == "one\ntwo"
    assert text("plain text") == "plain text" and text("") == "" and text("<p>cut <b") == "cut"
    assert text("<p>a</b>b</p></div>c<script>never closed <p>x") == "ab\nc"
    assert text('<p title="unclosed>a</p><p>b</p>') in ("a\nb", "b")
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("<article>t &am") == "t &am" and text("<main><p>m</p></main><p>n</p>") == "m"


def test_names_on_what_holds_the_page():
    body = "<p>one two three</p><p>four five six</p>"
    want = "one two three\nfour five six"
    for wrap in ('<div class="content-sidebar-wrap"><main>%s</main><div class=sidebar>s</div></div>',
                 '<div id="page" class="site no-sidebar"><nav>menu of the site</nav><article>%s</article></div>',
                 '<div class="has-banner">%s</div><footer>all rights</footer>', '<form action=x><nav>menu</nav><article>%s</article></form>',
                 '<article><div class="no-comments">%s</div></article>', '<div class=sidebar>ad<article>x</article></div>%s'):
        assert text(f"<body>{wrap % body}</body>") == want
    card = '<article class="teaser"><h3>next</h3></article>'
    assert text(f"<body><div>{body}</div>{card}{card}</body>") == want + "\nnext\nnext"
    assert text(f"<body><main></main><div>{body}</div></body>") == want
    assert text(f'<body><article>{body}</article><div class="sidebar">{card}</div><p>x</p></body>') == want


def recursion(pages, p):
    """(pages, importance) by node, straight from the definition."""
    rows = [[row for _, row in ht.Page(h).nodes(p.depth)] for h in pages]
    kids = defaultdict(set)
    styles, contents = defaultdict(Counter), defaultdict(Counter)
    for page in rows:
        for r in page:
            kids[r["parent"], r["pstyle"]].add(r["key"])
            styles[r["key"]][r["style"]] += 1
            if r["style"] == 0:
                contents[r["key"]][r["content"]] += 1

    def imp(key):
        s = styles[key]
        m = sum(s.values())
        node = 1.0 if m == 1 else -sum(n / m * math.log(n / m, m) for n in s.values())
        comp = 0.0
        for style, n in s.items():
            if style == 0:
                c = contents[key]
                own = 1.0 if n == 1 else 1 - sum(math.log(k, n) for k in c.values()) / len(c)
            else:
                own = sum(map(imp, kids[key, style])) / len(kids[key, style])
            comp += n / m * own
        w = p.decay ** len(s)
        return (1 - w) * node + w * comp

    return {k: (sum(styles[k].values()), imp(k)) for k in styles}


def site(rng, n, repeated):
    """Pages with a menu, a notice without any telling name, and varied text, none of it marked."""
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    notice = [word() for _ in range(8)]
    out = []
    for k in range(n):
        body = "".join(f"<p>{' '.join(word() for _ in range(9))}</p>" for _ in range(rng.randint(1, 5)))
        side = notice if repeated else [word() for _ in range(8)]
        out.append(f"<body><div class=x1><span>{side[0]}</span><div>{' '.join(side)}</div></div><div class=x2>{body}</div></body>")
    return out


def test_importance_and_cuts(spark):
    rng = random.Random(4)
    p = ht.Pruning()
    pages = site(rng, 30, True) + site(rng, 3, True)
    df = spark.createDataFrame([("h", k, r) for k, h in enumerate(pages) for _, r in ht.Page(h).nodes(p.depth)],
                               "host string, page int, r struct<key:bigint,parent:bigint,pstyle:bigint,style:bigint,content:bigint,depth:int>")
    got = {r.key: (r.pages, r.importance) for r in ht.importance(df.select("host", "r.*"), p, lambda d, n: d).collect()}
    want = recursion(pages, p)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)

    many, few, other = site(rng, 30, True), site(rng, 4, True), site(rng, 30, False)
    marked = [f"<body><article><p>same on all pages</p><p>{k}</p></article><p>x</p></body>" for k in range(20)]
    rows = [(f"http://Many.example:80/{k}", h) for k, h in enumerate(many)] + [("http://many.example/", many[0])] * 3
    rows += [(f"https://few.example/{k}", h) for k, h in enumerate(few)] + [(f"http://other.example?{k}", h) for k, h in enumerate(other)]
    rows += [("http://marked.example/a", h) for h in marked] + [(None, "<p>x"), (None, None), ("http://empty.example", "")]
    df = spark.createDataFrame([(None if k % 17 == 16 else k // 2, u, h, "h", 1, "t") for k, (u, h) in enumerate(rows)], SCHEMA)
    out = ht.extracted(df).collect()
    assert sorted((r.page_id or -1, r.url or "") for r in out) == sorted(
        (-1 if k % 17 == 16 else k // 2 or -1, u or "") for k, (u, _) in enumerate(rows))
    assert all(r.n_chars == len(r.text) for r in out)
    paragraphs = lambda h: "\n".join(x.split("</p>")[0] for x in h.split("<p>")[1:])
    whole = Counter()
    for u, h in rows:
        if u and "many" in u.lower():
            whole[u, paragraphs(h)] += 1  # the repeated notice is cut
        elif u and ("few" in u or "other" in u):
            whole[u, text(h)] += 1  # too few pages to tell, or varied everywhere
        else:
            whole[u, text(h or "")] += 1
    assert Counter((r.url, r.text) for r in out) == whole
    assert ht.extracted(df.limit(0)).collect() == []


def test_tree_cuts_inside_main_parts(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefg", k=6))
    notice = "<div class=x7><p>written for all readers of this site</p></div>"
    body = ["".join(f"<p>{' '.join(word() for _ in range(12))}</p>" for _ in range(rng.randint(1, 6))) for _ in range(20)]
    rows = [(k, f"http://a.example/{k}", f"<body><{m}><h1>{word()}</h1>{b}{notice}</{m}></body>", "h", 1, "t")
            for k, b in enumerate(body) for m in [("article", "main")[k % 2]]]
    plain = {k: text(h.replace(notice, "")) for k, _, h, *_ in rows}
    out = {r.page_id: r.text for r in ht.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == plain


def test_varied_text_among_children_is_important(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefg", k=6))
    rows = [(k, f"http://a.example/{k}", f"<article><p>{word()} {word()}<br>{word()} <b>{word()}</b><br>{word()}</p><h2>{word()}</h2></article>",
             "h", 1, "t") for k in range(20)]
    out = {r.page_id: r.text for r in ht.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {k: text(h) for k, _, h, *_ in rows}


def test_hosts_of_few_pages_and_deep_elements(spark, tables):
    from topicloom.llm.queries import QUERIES

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefg", k=6))
    menu = "<div><span>start</span> <span>about us</span></div>"
    rows = []
    for n in (2, 3, 7, 9):
        for k in range(n):
            body = f"<p>{' '.join(word() for _ in range(30))}</p>"
            rows.append((len(rows), f"http://few{n}.example/{k}", f"<body>{menu}<div>{body}</div></body>", "h", 1, body[3:-4]))
            page = "<div>" * 15 + menu + f"<div>{body}</div>" + "</div>" * 15
            rows.append((len(rows), f"http://deep{n}.example/{k}", page, "h", 1, body[3:-4]))
    near = [f"<body><p>{' '.join(['same'] * 40)}</p><p>{k}</p></body>" for k in range(2)]
    rows += [(len(rows) + k, "http://near.example/", h, "h", 1, text(h)) for k, h in enumerate(near)]
    where = tables(pages=spark.createDataFrame(rows, SCHEMA))
    out = {r.page_id: r.text for r in QUERIES["op4_site_style_tree"](spark, where).collect()}
    assert out == {k: want for k, _, _, _, _, want in rows}
