"""Wrapper induction against planted articles, and simple tree matching against all alignments."""

import html
import random
import re
from itertools import combinations

import pyarrow.parquet as pq
import pytest

from scoreframe.llm import html_extraction as hx

DATA = "/root/testdata/sf0.01"
ARTICLE = re.compile(r"<article>(.*?)(?:</article>|$)", re.S)


def planted(source):
    """The article of a page of the given tables: its heading and paragraphs."""
    inner = ARTICLE.search(source)[1]
    parts = (html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", x))).split() for x in re.split(r"</?(?:h1|p)>", inner))
    return "\n\n".join(" ".join(x) for x in parts if x)


def text_of(source):
    page = hx.Page(source)
    return hx.main_blocks(page, frozenset(), [0] * len(page.tag))


def test_articles_of_the_given_pages(spark):
    got = {r["page_id"]: r for r in hx.main_text(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    rows = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == planted(r["html"]) and got[r["page_id"]]["n_chars"] == len(planted(r["html"])) and got[r["page_id"]]["url"] == r["url"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_constant_nodes_are_template(spark):
    """Pages without an article element: constant nodes go by alignment with the reference, though some pages have an element more."""
    rng, rows, want = random.Random(4), [], {}
    for i in range(12):
        paragraphs = [words(rng, 30) for _ in range(rng.randrange(1, 5))]
        extra = f"<div class=lead>{words(rng, 9)}</div>" if i % 3 == 0 else ""
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f"<body><div>Welcome to our site</div>{extra}<div class='text'><h2>{words(rng, 4)}</h2>{body}<div>Read more of this &amp; that</div></div><div>All rights are ours</div></body>"
        rows.append((i, "http://One.example.org/" + str(i), page))
        want[i] = [b for b in text_of(page) if b not in ("Welcome to our site", "Read more of this & that", "All rights are ours")]
    copies = "<body><div>Same title of all</div><div><p>One text that all pages of the host have</p></div></body>"
    rows += [(100 + i, f"http://two.example.org/{i}", copies) for i in range(5)]
    rows += [(200 + i, None, copies) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in hx.main_text(pages).collect()}
    for i, blocks in want.items():
        assert got[i] == "\n\n".join(blocks)
    assert {got[i] for i in got if i >= 100} == {"Same title of all\n\nOne text that all pages of the host have"}
    found = hx.wrappers(hx.with_host_and_path(pages)).collect()
    assert [r["host"] for r in found] == ["one.example.org"] and len(found[0]["constant"]) == 3
    # The same wrappers by a join.
    most, hx.BROADCAST_BYTES = hx.BROADCAST_BYTES, -1
    try:
        assert got == {r["page_id"]: r["text"] for r in hx.main_text(pages).collect()}
    finally:
        hx.BROADCAST_BYTES = most


@pytest.mark.parametrize(
    ("source", "blocks"),
    [
        ("", []),
        ("plain &lt;text&gt; &am &amp", ["plain <text> &am &"]),
        ("<p>one<p>two<br>lines<div>three <b>bold</b> <i>word</div>four", ["one", "two lines", "three bold word", "four"]),
        ("<article><header><h1>T</h1></header><p>a</p><footer>f</footer><div class='ad-box'>x</div><section id=comments><p>c</p></section></article><p>out</p>", ["T", "a"]),
        ("<header>h</header><main><p>a</p></main><aside>s</aside>", ["a"]),
        ("<body class='has-comments'><div class='articleBody'>a</div><div class='siteFooter'>f</div><div class=cookieNotice>n</div>", ["a"]),
        ("<div><a href=x>menu</a> <a href=y>more</a></div><p>A text with <a href=z>one link</a> in it</p>", ["A text with one link in it"]),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><p>a<!-- <p>no</p> -->b</p><script>open", ["ab"]),
        ('<p title="a > b">x</p><p title="open>y</p>', ["x", "y"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>", ["a", "b", "c", "d", "1", "2", "3"]),
        ("<p>1 < 2 and <3</p></b></p><p>end <", ["1 < 2 and <3", "end <"]),
        ("<article><p>a</p><article class='comment'><p>reader</p></article></article>", ["a"]),
        ("<p style='display: none'>no</p><p hidden>no</p><form>f</form><p>a&nbsp;&nbsp;b</p>", ["a b"]),
        ("<p>cut <em at the end", ["cut"]),
    ],
)
def test_blocks(source, blocks):
    assert text_of(source) == blocks


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    page = hx.Page(deep)
    assert [b[1] for b in page.blocks] == ["text"] and hx.matched(page.skeleton()[0], page.skeleton()[0])[-1] >= 0
    wide = hx.Page("".join(f"<div class='{'abc'[k % 3]}'>w</div>" for k in range(1500))).skeleton()[0]
    other = hx.Page("".join(f"<div class='{'acb'[k % 3]}'>w</div>" for k in range(1500))).skeleton()[0]
    assert sum(x >= 0 for x in hx.matched(wide, other)) > 500
    assert len(hx.Page("<p>" + "word " * 400_000).blocks[0][1]) == 5 * 400_000 - 1
    assert hx.Page('<a x="' * 20_000).blocks == []


def best(a, b, kids_a, kids_b, sign_a, sign_b):
    """Most nodes of two trees that an ordered top-down alignment matches, by trying all choices of children."""
    if sign_a[a] != sign_b[b]:
        return 0
    left, right, most = kids_a[a], kids_b[b], 0
    for n in range(min(len(left), len(right)) + 1):
        for x in combinations(left, n):
            for y in combinations(right, n):
                most = max(most, sum(best(i, j, kids_a, kids_b, sign_a, sign_b) for i, j in zip(x, y, strict=True)))
    return most + 1


def test_tree_matching_equals_all_choices():
    rng = random.Random(8)

    def tree():
        lines, depth = ["0 r"], 0
        for _ in range(rng.randrange(1, 8)):
            depth = rng.randrange(1, depth + 2)
            lines.append(f"{depth} {rng.choice('ab')}")
        return "\n".join(lines)

    for _ in range(300):
        one, two = tree(), tree()
        sign_a, kids_a, _ = hx._tree(one)
        sign_b, kids_b, _ = hx._tree(two)
        to = hx.matched(one, two)
        assert sum(x >= 0 for x in to) == best(0, 0, kids_a, kids_b, sign_a, sign_b)
        assert sorted(x for x in to if x >= 0) == sorted({x for x in to if x >= 0}) and all(sign_a[i] == sign_b[x] for i, x in enumerate(to) if x >= 0)


@pytest.mark.parametrize("n", [40, 501, 900])
def test_tree_matching_is_ordered_at_any_size(n):
    """Lists of children of any length are aligned by one rule: in order, and most nodes."""
    rng = random.Random(n)
    one, two = ([rng.choice("abc") for _ in range(n + k)] for k in (0, 7))
    to = hx.matched("\n".join(["0 "] + [f"1 {s}" for s in one]), "\n".join(["0 "] + [f"1 {s}" for s in two]))
    before = [0] * (len(two) + 1)
    for x in one:
        row = [0]
        for j, y in enumerate(two, 1):
            row.append(max(before[j], row[j - 1], before[j - 1] + (x == y)))
        before = row
    pairs = [(i, x) for i, x in enumerate(to[1:]) if x >= 0]
    assert len(pairs) == before[-1] and all(one[i] == two[x - 1] for i, x in pairs)
    assert all(x < y for (_, x), (_, y) in zip(pairs, pairs[1:], strict=False))


def test_tree_matching_remembers_only_to_save_time(monkeypatch):
    rng = random.Random(6)
    trees = ["\n".join(["0 "] + [f"1 {rng.choice('ab')}\n2 {rng.choice('cd')}\n2 {rng.choice('cd')}\n3 {rng.choice('ef')}" for _ in range(25)]) for _ in range(8)]
    want = [hx.matched(x, y) for x in trees for y in trees]
    monkeypatch.setattr(hx, "REMEMBERED", 1)
    assert [hx.matched(x, y) for x in trees for y in trees] == want


def test_edges(spark):
    rows = [(1, "http://a.example/x", None, "t"), (1, "http://a.example/x", "", "t"), (None, "no host", "<p>x</p>", None), (2, None, "<p>y</p>" * 3, "u")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "'c' AS host", "'d' AS skeleton", "1 AS n_chars")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in hx.main_text(pages).collect()), key=str)
    assert got == [(0, "x", 1), (1, "", 0), (1, "", 0), (2, "y\n\ny\n\ny", 7)]
    assert hx.main_text(pages).columns == ["page_id", "url", "text", "n_chars"] and hx.main_text(pages.limit(0)).count() == 0
