"""Encoding, token counts, extraction and the pipeline."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtide.llm import bpe, html_extract, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_the_library(spark, odd, empty):
    special = spark.createDataFrame([(900, "Hello  world's <|endoftext|> ÀÉ!!! 12ab\n foo"), (901, "ΣΑΣ İI ß ​ x\x1cy\x85z"), (902, "<|startoftext|>x<|ENDOFTEXT|>")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").union(special)
    t = Tokenizer.from_file(PATH)
    want = []
    for r in rows.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r)[1:] for r in bpe.digests(rows, PATH).collect()) == sorted(want)
    assert bpe.digests(empty, PATH).count() == 0
    back = bpe.decode(bpe.encode(special, PATH), PATH).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {r["doc_id"]: t.decode(t.encode(r["text"], add_special_tokens=False).ids, skip_special_tokens=False) for r in special.collect()}


def test_a_task_leaves_no_words_behind(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "sha2(string(id), 256) AS text")
    assert bpe.encode(rows, PATH).selectExpr("sum(size(ids))").first()[0] > 3000

    def look(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(e.cache) for e in bpe._encoders.values()]}, pa.schema([("n", pa.int64())]))

    left = [r["n"] for r in spark.range(0, 32, 1, 32).mapInArrow(look, "n long").collect()]
    assert left and not any(left)  # processes that encoded are there, their words are not


def test_words_that_a_cache_drops_are_encoded_again(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CACHED", 40)
    monkeypatch.setattr(bpe, "AT_ONCE", 300, raising=False)
    e, t = bpe.Encoder(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    texts = [" ".join(f"w{'abcdefghij'[k % 10]}{'klmnopq'[k % 7]} the {k}" for k in range(n, n + 9)) for n in range(300)] + [None, "", "one word " * 500, "<|endoftext|>"]
    for text, (ids, _) in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids
        assert len(e.cache) <= 100 and len(e.before) <= 100


def test_pair_test_is_the_merging():
    v = bpe.Encoder(open(PATH, encoding="utf-8").read()).v
    rng = np.random.default_rng(2)
    inner, last = list(v.inner.items()), list(v.last.items())
    a = [inner[k] for k in rng.integers(0, len(inner), 4000)]
    b = [last[k] for k in rng.integers(0, len(last), 4000)]
    ok = v.fitting(np.array([x[1] for x in a]), np.array([x[1] for x in b]))
    want = [v.merged(x[0] + y[0]) == [x[1], y[1]] for x, y in zip(a, b, strict=True)]
    assert ok.tolist() == want and 0 < sum(want) < 4000


def test_words_side_by_side_equal_one_by_one(monkeypatch):
    import random

    e, rng = bpe.Encoder(open(PATH, encoding="utf-8").read()), random.Random(9)
    words = list({"".join(rng.choices(letters, k=rng.randrange(1, 130))) for _ in range(150) for letters in ("ab", "etaoinshrdlu", "äß日", "a1!'")} | {"the", "a", "b", *e.v.inner, *e.v.last})
    spelled = ["".join(e.letters[b] for b in w.encode()) for w in words[:3000]]
    want, short = [e.v.merged(w) for w in spelled], [w for w in spelled if len(w) <= bpe.SHORT]
    proposed = [e.v.proposed(w) for w in short]
    for got, rows in ((e.v.proposed_all(short), proposed), (e.v.merged_all(short), [e.v.merged(w) for w in short])):
        assert [got[1][got[0] == k].tolist() for k in range(len(short))] == rows
    # no word within SHORT letters is proposed or merged by itself
    one = e.v.merged, e.v.proposed
    alone = lambda f: lambda w: f(w) if len(w) > bpe.SHORT else pytest.fail("a short word by itself")
    monkeypatch.setattr(e.v, "merged", alone(one[0]))
    monkeypatch.setattr(e.v, "proposed", alone(one[1]))
    for some in (spelled, spelled[:1], []):
        flat, size = e.v.encoded(some)
        ends = np.cumsum(size).tolist()
        assert [flat[b - n : b].tolist() for b, n in zip(ends, size.tolist(), strict=True)] == want[: len(some)]


def test_long_words_equal_the_library():
    import random
    import time

    e, t, rng = bpe.Encoder(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH), random.Random(4)
    texts = ["".join(rng.choices(letters, k=n)) for n in (*range(1, 40), 99, 100, 101, 102, 300, 1000, 5000) for letters in ("ab", "etaoinshrdlu", "äöüß", "日本語")]
    texts += ["a" * n for n in (100, 101, 257, 4096)] + ["abab" * 700, "xyz" + "the" * 900]
    for text, (ids, _) in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    began = time.process_time()
    (ids, _), = e.encode(["".join(rng.choices("etaoinshrdlu", k=1_000_000))])
    assert len(ids) > 400_000 and time.process_time() - began < 30


def test_trie_counts_equal_plain_programming(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.load_pieces(path)

    def plain(word):
        w = token_counts.MARK + word
        best = [(0.0, 0)]
        for j in range(1, len(w) + 1):
            n = len(w[j - 1].encode())
            c = [(-(best[j - 1][0] + token_counts.BYTE_SCORE * n), best[j - 1][1] + n)]
            c += [(-(best[i][0] + pieces[w[i:j]]), best[i][1] + 1) for i in range(max(0, j - 40), j) if w[i:j] in pieces]
            low = min(c)
            best.append((-low[0], low[1]))
        return best[-1][1]

    rows = odd
    words = [[x.decode() for x in (r["text"] or "").encode().split()] for r in rows.select("text").collect()]
    got = token_counts.count_tokens(rows, path).collect()
    assert sorted((r["n_words"], r["n_tokens"]) for r in got) == sorted((len(w), sum(map(plain, w))) for w in words)
    assert token_counts.count_tokens(empty, path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice">We value your privacy.</div><div class="ad">Buy this now.</div>
<article><h1>The &amp; title</h1><p>First   para with <a href="x">a link</a>, and <b>bold
text</b>.<p>Second&nbsp;para &lt;here&gt;<br>after a break.<ul><li>one<li>two</ul><form>Sign up</form>
<blockquote>Quoted words.</blockquote></article>
<section id="comments"><p>A reader says something about it all, at length.</p></section><aside>Related</aside><footer>&copy; 2026</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "The & title First para with a link, and bold text. Second para <here> after a break. one two Quoted words."),
        (None, ""), ("", ""), ("<p></p>", ""), ("just words", "just words"), ("<div><p>a<p>b", "a b"), ("<body><p>x <!-- no --> y</p><script>z", "x y"), ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_articles(page, text):
    assert html_extract.article(page) == text


def test_article_without_an_article_element():
    body = "".join(f"<p>Paragraph {k} has a good many words in it, so that its density is high enough.</p>" for k in range(6))
    page = f'<body><ul class="menu"><li><a>One</a><li><a>Two</a></ul><div class="x"><h2>Head</h2>{body}</div><div class="sidebar">Also <a>this</a></div></body>'
    got = html_extract.article(page)
    assert got.startswith("Head Paragraph 0") and got.endswith("high enough.") and "One" not in got and "Also" not in got


def test_densities_decide_inside_main():
    para = "".join(f"<p>Paragraph {k} has a good <b>many words</b> in it, so that its density is high enough.</p>" for k in range(6))
    links = "".join(f'<li><a href="/{k}">Another story {k}</a></li>' for k in range(9))
    page = f"<body><main><h1>Title</h1><ul>{links}</ul><div>{para}</div><section><ul>{links}</ul></section></main></body>"
    got = html_extract.article(page)
    assert got.startswith("Title Paragraph 0") and got.endswith("high enough.") and "Another" not in got
    # an article element does not outweigh a denser part of the page that has none, and a short one beside a long one may stay
    got = html_extract.article(f"<body><article><ul>{links}</ul></article><div>{para}</div></body>")
    assert got.startswith("Paragraph 0") and "Another" not in got
    short = "<article><p>A short update of one sentence, as dense as any of them but much less than a tenth of what is beside it.</p></article>"
    got = html_extract.article(f"<body><article>{para * 4}</article>{short}</body>")
    assert got.endswith("what is beside it.") and got.count("Paragraph 0") == 4


@pytest.mark.parametrize("wrapper", ['div class="content has-sidebar"', 'div id="layout-with-sidebar"', 'section class="legal-news"'])
def test_names_of_wrappers_lose_no_article(wrapper):
    para = "".join(f"<p>Paragraph {k} has a good many words in it, so that its density is high enough.</p>" for k in range(6))
    side = '<div class="sidebar"><ul><li><a href="/a">Also this</a></ul></div><div class="ad">Buy this now.</div>'
    for inner in (f"<article><h1>Title</h1>{para}</article>", f"<main>{para}</main>", f"<h1>Title</h1>{para}", para, f"<div>{para}</div>"):
        got = html_extract.article(f"<body><nav>Menu</nav>{side}<{wrapper}>{inner}</{wrapper.split()[0]}></body>")
        assert got == " ".join(re.sub("<.*?>", " ", inner).split())
    # parts of the article that are named alike
    parts = "".join(f'<div class="side-story"><p>Story {k} has a good many words in it, so that its density is high.</p></div>' for k in range(5))
    got = html_extract.article(f"<body>{side}<div>{parts}</div></body>")
    assert got.count("Story") == 5 and "Also" not in got


PARAGRAPHS = "".join(f"<p>Paragraph {k} of the article has a good many words in it, so that its density is high.</p>" for k in range(3))
READERS = "<p>A reader says something about it all, at length and more.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<nav><a href="/">Home</a></nav><article><h1>T</h1><div class="legal">{PARAGRAPHS}</div><p>The end of it, with some words more.</p></article>',
        f'<article><h1>T</h1><div class="section-header"><p>The intro has some words in it for the reader.</p></div>{PARAGRAPHS}</article>',
        f'<article><h1>T</h1><p class="side">A side remark that belongs to the article itself.</p>{PARAGRAPHS}</article>',
        f"<main><article><h1>T</h1>{PARAGRAPHS * 5}</article></main><article><p>A short second article, outside main.</p></article>",
    ],
)
def test_parts_of_the_article_stay(page):
    want = " ".join(re.sub("<.*?>", " ", page.replace('<nav><a href="/">Home</a></nav>', "")).split())
    beside = f'<div class="notice">Down on Sunday for some hours, as every year.</div><div id="header">Site name</div><section id="comments">{READERS}</section>'
    for body in (page, beside + page, page + beside, page.replace("</article>", f'<div class="ad-slot">Buy this.</div><div class="comments"><article class="comment">{READERS}</article></div></article>', 1)):
        assert html_extract.article(f"<html><body>{body}</body></html>") == want


LONG = "The harbour town was built where the river meets the sea, and its oldest houses still stand on wooden piles."
NOTE = "Boats leave at nine."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (
            f"<body><nav><a href='/'>Home</a></nav><main><section><h2>One</h2>{f'<p>{LONG}</p>' * 5}</section><section><h2>Two</h2><p>{NOTE}</p></section><section><h2>Three</h2>{f'<p>{LONG}</p>' * 3}</section></main></body>",
            f"One {' '.join([LONG] * 5)} Two {NOTE} Three {' '.join([LONG] * 3)}",
        ),
        (f'<body><article><h1>T</h1><p>{LONG}</p><section id="related-work"><h2>Related work</h2><p>{LONG}</p></section></article></body>', f"T {LONG} Related work {LONG}"),
        (f'<body><article><h1>T</h1><p>{LONG}</p><div class="search-tips"><p>{NOTE}</p></div></article></body>', f"T {LONG} {NOTE}"),
        (f'<body><article><h1>T</h1><section id="comments-on-method"><p>{LONG}</p></section><p>{LONG}</p></article></body>', f"T {LONG} {LONG}"),
        (f'<body><article><h1>T</h1><p>{LONG}</p><p class="reply">{NOTE}</p></article></body>', f"T {LONG} {NOTE}"),
        (f'<body><article><h1>T</h1><div class="share-prices"><p>{LONG}</p></div><p>{NOTE}</p></article></body>', f"T {LONG} {NOTE}"),
        (f'<body><form id="aspnetForm"><input name="q"><article><h1>T</h1><p>{LONG}</p><form>Sign up</form></article></form></body>', f"T {LONG}"),
        (f'<body><form id="aspnetForm"><div><p>{LONG}</p><p>{LONG}</p></div><button>Go</button></form></body>', f"{LONG} {LONG}"),
        (f"<body><div><section><header><h2>Head</h2></header><p>{LONG}</p></section></div></body>", f"Head {LONG}"),
        (f'<body><article><h1>T</h1><p>{LONG}</p><div class="related-posts"><p>{LONG}</p></div><ul class="share-links"><li>Post it</ul><p>{NOTE}</p></article></body>', f"T {LONG} {NOTE}"),
        (f"<body><main><p>{LONG}</p><ul><li><a href='/1'>First story</a><li><a href='/2'>Second story</a><li><a href='/3'>Third story</a></ul><p>See <a href='/4'>here</a></p></main></body>", f"{LONG} See here"),
        ("<body><div><p>Equal words here</p></div><div><p>Equal words here</p></div></body>", "Equal words here Equal words here"),
        ("<body></p></b></div><p>a</b> b</p></p></body>", "a b"),
    ],
)
def test_nothing_else_is_dropped(page, text):
    assert html_extract.article(page) == text


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</p>" * 20_000, "<p>" + "<b>" * 20_000 + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<h1>" * 20_000, "<b>" * 20_000 + "<p>x" * 20_000, "<a " * 40_000, "<![CDATA[>" * 15_000, '<div class="side">' * 20_000, "<ul><li>" * 15_000])
def test_stray_tags_cost_a_look_each(page):
    import time

    began = time.process_time()
    html_extract.article(page + "<p>End of it.</p>")
    assert time.process_time() - began < 3


def test_menus_that_are_never_closed():
    menu = '<ul><li><a href="/">Home</a><li><a href="/b">Other</a></ul>'
    for tag in ("nav", "aside", "header"):
        got = html_extract.article(f"<body><{tag}>{menu}<div><h1>T</h1>{PARAGRAPHS}</div></body>")
        assert got.startswith("T Paragraph 0") and got.endswith("density is high.") and "Home" not in got
    assert html_extract.article(f"<body><nav>{menu}</nav><div>{PARAGRAPHS}</div><nav>Last").count("Paragraph") == 3


def test_extraction_equals_a_recursive_version(spark):
    """Densities by recursion over a tree of the standard library's parser, on whole tables of pages."""
    import math
    from html.parser import HTMLParser

    h = html_extract

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.at = {"name": "#root", "kids": [], "up": None}

        def handle_starttag(self, name, attrs):
            node = {"name": name, "kids": [], "up": self.at, "cls": dict(attrs).get("class") or ""}
            self.at["kids"].append(node)
            if name not in h.VOID:
                self.at = node

        def handle_endtag(self, name):
            x = self.at
            while x["up"] and x["name"] != name:
                x = x["up"]
            if x["up"]:
                self.at = x["up"]

        def handle_data(self, data):
            self.at["kids"].append(data)

    def cut(x):
        return x["name"] in h.CUT or x["name"] == "header" and not inside(x) or x.get("cls") in ("ad", "comments", "sidebar")

    def inside(x):
        return x is not None and (x["name"] in ("article", "main") or inside(x["up"]))

    def counts(x):
        x["kids"] = [k for k in x["kids"] if isinstance(k, str) or not cut(k)]
        x["c"] = sum(len("".join(k.split())) for k in x["kids"] if isinstance(k, str))
        x["t"] = x["lc"] = x["lt"] = 0
        for k in (k for k in x["kids"] if not isinstance(k, str)):
            counts(k)
            x["c"], x["t"], x["lc"], x["lt"] = x["c"] + k["c"], x["t"] + k["t"] + 1, x["lc"] + k["lc"], x["lt"] + k["lt"] + (k["name"] == "a")
        x["lc"] = x["c"] if x["name"] == "a" else x["lc"]

    def densities(x, share):
        c, t, lc, lt = x["c"], max(1, x["t"]), x["lc"], max(1, x["lt"])
        x["d"] = 0.0
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            x["d"] = c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / lt))) / base
            if not x["t"]:
                x["d"] = max(x["d"], c / t * math.log(max(1.0, c / max(1, lc))) / base)
        nodes = [k for k in x["kids"] if not isinstance(k, str)]
        for k in nodes:
            densities(k, share)
        x["b"] = sum(k["b"] if k["name"] in h.INLINE else k["d"] for k in nodes)
        x["sum"] = x["b"] or (0.0 if x["name"] in h.INLINE else x["d"])

    def every(x):
        yield x
        for k in x["kids"]:
            if not isinstance(k, str):
                yield from every(k)

    def largest(x):
        return max(every(x), key=lambda y: y["sum"])

    def text(x, keep):
        keep = keep or x.get("keep", False)
        inner = "".join((k if keep else "") if isinstance(k, str) else text(k, keep) for k in x["kids"])
        return inner if x["name"] in h.INLINE else f" {inner} "

    def plain(page):
        t = Tree()
        t.feed(page)
        t.close()
        counts(t.root)
        densities(t.root, t.root["lc"] / max(1, t.root["c"]))
        path = [largest(t.root)]
        while path[-1]["name"] != "body" and path[-1]["up"]:
            path.append(path[-1]["up"])
        least = min(x["d"] for x in path)

        def mark(x):
            if x["d"] >= least and x["c"] and not x.get("keep"):
                largest(x)["keep"] = True
                for k in x["kids"]:
                    if not isinstance(k, str):
                        mark(k)

        mark(path[-1])
        for x in path[1:]:
            for k in x["kids"]:
                if not isinstance(k, str) and k["name"] == "h1":
                    k["keep"] = True
        for x in every(t.root):
            if x["name"] == "article" and 2 * x["lc"] < x["c"]:
                x["keep"] = True
        return " ".join(text(t.root, False).split())

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    rows = pages.collect()
    assert len(rows) == len(got) and all(got[r["page_id"]]["text"] == plain(r["html"]) and got[r["page_id"]]["url"] == r["url"] for r in rows)


def test_empty_tables_and_clashing_columns_of_pages(spark):
    schema = "page_id int, url string, html string, text string, n_chars string, `a b` int"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", "<p>one two</p>", "x", "y", 1), (1, "u", "<p>one two</p>", "x", "y", 2), (None, None, None, None, None, None)]
    got = sorted(tuple(str(v) for v in r) for r in html_extract.extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "u", "one two", "7"), ("1", "u", "one two", "7"), ("None", "None", "", "0")]


def test_long_pages_and_rows(spark):
    page = "<article>" + "<p>word and more</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id long, url string, html string")
    got = html_extract.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 20_000 * 14 - 1, 20_000 * 14 - 1]
