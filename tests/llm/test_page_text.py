import html
import random
import re
import time

import numpy as np
import pytest

from usagelens.llm import page_text
from usagelens.llm.dom import Pages, Tree
from usagelens.llm.queries import op9_page_text


@pytest.fixture(scope="module")
def trees():
    return page_text.fit()


def article(source):
    """The article of the driver's pages, by its element."""
    inside = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?p>|</?h1>", inside)]
    return "\n".join(b for b in blocks if b)


def test_query(spark, medium):
    pages = {r.page_id: r for r in spark.read.parquet(f"{medium}/pages.parquet").collect()}
    rows = op9_page_text(spark, medium).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == article(pages[r.page_id].html)


def test_generated_pages_of_other_seeds(trees):
    rng = random.Random(77)
    made = [page_text.generated_page(rng) for _ in range(200)]
    pages = Pages()
    for m in made:
        pages.add(m)
    tree = Tree(pages)
    told = [[] for _ in made]
    for node, text in zip(pages.run_node, pages.run_text, strict=True):
        if page_text.MARK in text:
            told[tree.page[node]].append(text.replace(page_text.MARK, "").strip())
    found = page_text.extract([m.replace(page_text.MARK, "") for m in made], trees)
    assert np.mean([a == "\n".join(b) for a, b in zip(found, told, strict=True)]) > 0.88


P = "Some words of the article that go on for a while, and then some more of them. "


def test_markup_is_read_as_told(trees):
    source = (
        "<HTML><body><NAV class=menu><a href=/a>Home</a> <a href=/b>News</a></NAV><article><h1>A &amp; B&nbsp;title</h1>"
        f"<!-- <p>no</p> --><p>{P} x &lt; y<br>z <b>bo</b>ld</p><script>var a='</p>';</script><p>{P}<p>  {P}\n\n </article>"
        "<footer>&copy; 2026 Somebody</footer>"
    )
    line = P.strip()
    assert page_text.extract([source], trees) == [f"A & B title\n{line} x < y z bold\n{line}\n{line}"]


def test_skipped_elements_without_end_tag_leave_the_page():
    pages = Pages()
    pages.add("<p>a<svg class=x /> b<math/></p><p>c<svg><text>no</text></svg></p><noscript><object><canvas><p>d</p><script>no <p>no</p>")
    assert pages.run_text == ["a b", "c", "d"]


@pytest.mark.parametrize("shape", ["<div>", "<b>x</i>", "<a ", '<a x="', "<a '>", "<p>", "<svg>", "</p>", "<!--", "<!-- x", "<li><ul>", "<table><tr><td>", "&lt;", "<p><button><div>"])
def test_broken_pages_of_a_megabyte_take_seconds(trees, shape):
    began = time.time()
    page_text.extract([shape * (1_000_000 // len(shape))], trees)
    assert time.time() - began < 40


def test_elements_end_where_others_begin():
    pages = Pages()
    pages.add("<p>a<div>b<p>c</div>d<ul><li>e<ul><li>f</ul><li>g</ul><table><tr><td>h<td>i<tr><td><p>j</table>k</p>l<b>m</i>n</b>")
    assert pages.run_text == list("abcdefghij") + ["klmn"]
    tree = Tree(pages)
    inside = lambda a, b: a == b or (tree.parent[b] >= 0 and inside(a, tree.parent[b]))
    size = len(tree.parent)
    values = np.random.default_rng(3).random(size)
    assert np.allclose(tree.up(values), [sum(values[b] for b in range(size) if inside(a, b)) for a in range(size)])
    masks = np.random.default_rng(4).integers(0, 1 << 12, size)
    assert tree.down(masks).tolist() == [int(np.bitwise_or.reduce([masks[a] for a in range(size) if inside(a, b)])) for b in range(size)]


def test_pages_whose_names_tell_nothing(trees):
    """The longest block is found; shorter ones beside it may not be."""
    source = f"<div><a href=/>Home</a> | <a href=/n>News</a></div><div>{P * 4}</div><div>{P * 5}</div><div>All rights</div>"
    assert (P * 5).strip() in page_text.extract([source], trees)[0].split("\n")


def prose(rng, least=20, most=70):
    return " ".join(rng.choice(("the", "of", "river", "some", "people", "said", "that", "house", "and", "long", "years", "council")) for _ in range(rng.randint(least, most))).capitalize() + "."


@pytest.mark.parametrize(("around", "least"), [("article", 0.95), ("div class=content", 0.95), ("main", 0.95), ("div", 0.4), ("", 0.4)])
@pytest.mark.parametrize("paragraphs", [1, 2, 3, 6])
@pytest.mark.parametrize("title", ["", "A title"])
def test_short_and_unnamed_articles(trees, around, least, paragraphs, title):
    """Articles of named elements are found whole from one paragraph on; of others something is found on every page."""
    if not around.startswith(("article", "main")) and title:
        title = ""
    rng, sources, texts = random.Random(paragraphs), [], []
    for _ in range(40):
        blocks = [prose(rng) for _ in range(paragraphs)]
        made = (f"<h1>{title}</h1>" if title else "") + "".join(f"<p>{b}</p>" for b in blocks)
        if around:
            made = f"<header><h1>Site name</h1></header><nav><a href=/a>Home</a> <a href=/b>News</a></nav><{around}>{made}</{around.split()[0]}><footer>&copy; 2024 Some Company</footer>"
        sources.append(f"<html><head><title>t</title></head><body>{made}</body></html>")
        texts.append("\n".join([title] * bool(title) + blocks))
    found = page_text.extract(sources, trees)
    assert all(found) and np.mean([a == b for a, b in zip(found, texts, strict=True)]) >= least


def test_pages_without_prose_stay_empty(trees):
    nav = "<nav class=menu><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
    assert page_text.extract([f"<html><body>{nav}</body></html>", f"<body>{nav}<footer class=footer>&copy; 2024 Some Company</footer></body>"], trees) == ["", ""]


def likeliest(tree, likely):
    """The cheapest labelling, by trying each set of mixed elements and each label of the others."""
    size, children = len(tree.parent), [[] for _ in tree.parent]
    for node in range(size):
        if tree.parent[node] >= 0:
            children[tree.parent[node]].append(node)
    direct = set(tree.run_node.tolist())
    cost = {True: -np.log(likely), False: -np.log(1 - likely)}

    def under(node):
        return [node, *(x for c in children[node] for x in under(c))]

    has = [bool(direct & set(under(n))) for n in range(size)]

    def tried(node):
        """All (cost, article elements) of a subtree."""
        told = [n for n in under(node) if has[n]]
        out = [(sum(cost[side][n] for n in told), {n for n in told if side}) for side in (False, True)]
        parts = sum(has[c] for c in children[node]) + (node in direct)
        ways = [(page_text.MIXED_COST if parts > 1 else 0.0, set())]
        if node in direct:
            ways = [(c + cost[side][node], s | ({node} if side else set())) for c, s in ways for side in (False, True)]
        for child in children[node]:
            ways = [(c + d, s | t) for c, s in ways for d, t in tried(child)]
        return out + ways

    return min(tried(0), key=lambda w: w[0])


@pytest.mark.parametrize("seed", range(40))
def test_decoding_finds_the_likeliest_labelling(seed):
    rng = random.Random(seed)

    def made(depth):
        return "".join(f"<div>{rng.choice(('', 'x'))}{made(depth + 1) if depth < 3 and rng.random() < 0.6 else ''}</div>" for _ in range(rng.randint(1, 2)))

    pages = Pages()
    pages.add(made(0))
    tree = Tree(pages)
    if len(tree.parent) > 11:
        return
    likely = np.random.default_rng(seed).uniform(0.02, 0.98, len(tree.parent))
    _, article = likeliest(tree, likely)
    assert page_text.article_runs(tree, likely).tolist() == [n in article for n in tree.run_node.tolist()]


def test_odd_and_no_pages(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p"), (5, "u", "</div></p>"), (6, "u", "<a b='c>" * 50), (None, "u", "<script>never closed"), (7, "u", "<div>" * 3000 + "x"), (7, "u", "<!--")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    found = page_text.page_texts(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert {r.page_id: r.text for r in found if r.page_id in (1, 2)} == {1: "", 2: ""}
    assert page_text.page_texts(pages.limit(0)).count() == 0


def test_labels_never_contradict(trees):
    pages = Pages()
    pages.add(f"<div><p>{P}</p><div><p>{P}</p></div></div>")
    tree = Tree(pages)
    likely = np.full(len(tree.parent), 0.9)
    likely[tree.run_node[1]] = 0.45
    assert page_text.article_runs(tree, likely).all()
    likely[:] = 0.01
    assert not page_text.article_runs(tree, likely).any()
