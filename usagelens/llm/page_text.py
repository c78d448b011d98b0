"""Operator 9: main text of web pages by boosted trees over block elements.

Gradient-boosted trees tell for each block element how likely its text belongs
to the article, from its tag, attribute words, text and link density, depth,
siblings and surroundings. The labels of a page are then decoded together: a
subtree is all article, all furniture, or mixed, and the likeliest consistent
choice is taken from the leaves up, so nothing contradicts an element around it.
Of a page that gives nothing that way, though some elements stand out, the
likelihoods are raised until the likeliest element with text is article, and it
is decoded once more.

The trees are fitted on a fixed number of generated pages of many layouts,
whose parts are known; pages of the table are never labels.

Cases: null html is empty and gives an empty text, as does a page without an
article; unclosed and stray tags are taken as browsers do, roughly; repeated
pages are read each; of labellings that are equally likely the one that calls a
subtree all furniture is taken before all article, and either before mixed; a
page of any length is read whole, in time linear in it, a few at once; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import kept_in_worker, map_texts
from usagelens.llm.dom import Pages, Tree, features

FIT_PAGES = 600
TREES, LEVELS, BINS, RATE, LEAST_LEAF, SHRINK = 60, 4, 32, 0.2, 20, 1.0
#: What it costs, in nats, to call a subtree mixed.
MIXED_COST = 1.5
#: A page of which nothing is chosen has an article from this likelihood of an element with text on; in nats, what it is raised to.
LEAST_RAISED, RAISED_TO = 0.05, 1.5
SLICE_BYTES = 1 << 20


class Trees:
    """Boosted regression trees of fixed depth for a yes-or-no label."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, rows.T, strict=True)], axis=1)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(labels), self.base)
        self.column, self.cut, self.leaf = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            z += self._grow(binned, labels - p, p * (1 - p))

    def _grow(self, binned: np.ndarray, slope: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Add one tree: at each level every node is split where the loss falls most."""
        place = np.zeros(len(slope), dtype=np.int64)
        columns, cuts = [], []
        for level in range(LEVELS):
            count = 1 << level
            best = np.zeros(count)
            column, cut = np.zeros(count, dtype=np.int64), np.full(count, BINS, dtype=np.int64)
            for k in range(binned.shape[1]):
                if not len(self.edges[k]):
                    continue
                key = place * (BINS + 1) + binned[:, k]
                sums = [np.bincount(key, weights=v, minlength=count * (BINS + 1)).reshape(count, -1).cumsum(axis=1) for v in (slope, weight, np.ones(len(slope)))]
                g, h, n = (s[:, :-1] for s in sums)
                all_g, all_h, all_n = (s[:, -1:] for s in sums)
                gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
                gain[(n < LEAST_LEAF) | (all_n - n < LEAST_LEAF)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(count), at] > best + 1e-9
                best[better] = gain[np.arange(count), at][better]
                column[better], cut[better] = k, at[better]
            columns.append(column)
            cuts.append(cut)
            place = 2 * place + (binned[np.arange(len(place)), column[place]] > cut[place])
        g = np.bincount(place, weights=slope, minlength=1 << LEVELS)
        h = np.bincount(place, weights=weight, minlength=1 << LEVELS)
        leaf = RATE * g / (h + SHRINK)
        self.column.append(columns)
        self.cut.append([np.array([self.edges[c][min(t, len(self.edges[c]) - 1)] if t < len(self.edges[c]) else np.inf for c, t in zip(cs, ts, strict=True)], dtype=np.float32) for cs, ts in zip(columns, cuts, strict=True)])
        self.leaf.append(leaf)
        return leaf[place]

    def likely(self, rows: np.ndarray) -> np.ndarray:
        z = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for columns, cuts, leaf in zip(self.column, self.cut, self.leaf, strict=True):
            place = np.zeros(len(rows), dtype=np.int64)
            for column, cut in zip(columns, cuts, strict=True):
                place = 2 * place + (rows[every, column[place]] > cut[place])
            z += leaf[place]
        return 1 / (1 + np.exp(-z))


def article_runs(tree: Tree, likely: np.ndarray) -> np.ndarray:
    """Which runs of text belong to the article, in the likeliest labelling without contradictions."""
    p = np.clip(likely, 1e-4, 1 - 1e-4)
    size = len(p)
    has_text = tree.up(np.bincount(tree.run_node, minlength=size)) > 0
    inside, outside = np.where(has_text, -np.log(p), 0.0), np.where(has_text, -np.log(1 - p), 0.0)
    all_in, all_out = tree.up(inside), tree.up(outside)
    # A run stands in its element as a leaf with that element's likelihood.
    direct = np.bincount(tree.run_node, minlength=size) > 0
    # The elements around a single part are mixed if it is: they cost nothing more.
    filled = np.flatnonzero(has_text & (tree.parent >= 0))
    several = np.bincount(tree.parent[filled], minlength=size) + direct > 1
    mixed = (np.where(direct, np.minimum(inside, outside), 0.0) + np.where(several, MIXED_COST, 0.0)).tolist()
    pure, parent = np.minimum(all_in, all_out).tolist(), tree.parent.tolist()
    for node in range(size - 1, -1, -1):  # nodes stand after those around them
        if parent[node] >= 0:
            mixed[parent[node]] += min(pure[node], mixed[node])
    chosen = np.where(np.array(mixed) < pure, 0, np.where(all_in < all_out, 1, -1)).tolist()
    label = [0] * size  # 0 mixed, 1 all article, -1 all furniture
    for node in range(size):
        label[node] = (label[parent[node]] if parent[node] >= 0 else 0) or chosen[node]
    label = np.array(label)
    own = np.where(label == 0, np.where(inside < outside, 1, -1), label)
    return own[tree.run_node] > 0 if len(tree.run_node) else np.zeros(0, dtype=bool)


def standing_out(tree: Tree, likely: np.ndarray, chosen: np.ndarray) -> np.ndarray | None:
    """Likelihoods for pages of which nothing was chosen, raised until the likeliest element with text is article; others are lowered.

    Most pages have an article: where names tell little, all elements may stay
    below one half, though some stand out. Pages whose likeliest element is below
    LEAST_RAISED have none. None if there is no such page.
    """
    count = len(tree.page) and int(tree.page.max()) + 1
    if not len(tree.run_node):
        return None
    of_run = tree.page[tree.run_node]
    has = np.bincount(of_run, weights=chosen, minlength=count) > 0
    top = np.zeros(count)
    np.maximum.at(top, of_run, likely[tree.run_node])
    lift = ~has & (top >= LEAST_RAISED)
    if not lift.any():
        return None
    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    raised = 1 / (1 + np.exp(-(logit(likely) + RAISED_TO - logit(top)[tree.page])))
    return np.where(lift[tree.page], raised, 0.0)


def extract(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page: its article's blocks in page order, a line each."""
    pages = Pages()
    for source in sources:
        pages.add(source)
    tree = Tree(pages)
    likely = trees.likely(features(pages, tree))
    chosen = article_runs(tree, likely)
    raised = standing_out(tree, likely, chosen)
    if raised is not None:
        chosen |= article_runs(tree, raised)
    out: list[list[str]] = [[] for _ in sources]
    for i in np.flatnonzero(chosen):
        out[tree.page[tree.run_node[i]]].append(pages.run_text[i])
    return ["\n".join(lines) for lines in out]


@lru_cache(maxsize=2)
def fit(seed: int = 9, count: int = FIT_PAGES) -> Trees:
    """Trees fitted on generated pages, once a session; text of the article carries a mark that the tree reader sees and removes."""
    pages = Pages()
    rng = random.Random(seed)
    for _ in range(count):
        pages.add(generated_page(rng))
    inside = np.array([MARK in t for t in pages.run_text])
    pages.run_text = [t.replace(MARK, "").strip() or "x" for t in pages.run_text]
    tree = Tree(pages)
    length = np.fromiter(map(len, pages.run_text), dtype=np.float64)
    size = len(tree.parent)
    share = tree.up(np.bincount(tree.run_node, weights=length * inside, minlength=size))
    whole = tree.up(np.bincount(tree.run_node, weights=length, minlength=size))
    told = whole > 0
    share = np.where(told, share / np.maximum(whole, 1), 0)
    clear = told & ((share < 0.05) | (share > 0.95))
    # Mixed elements are fitted too: they count for the side most of their text is on.
    use = clear | (told & (np.arange(size) % 3 == 0))
    return Trees(features(pages, tree)[use], (share[use] > 0.5).astype(np.float64))


MARK = "\x02"


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("ka", "ri", "ton", "el", "mo", "s", "an", "der", "u", "pli", "é", "or")) for _ in range(rng.randint(1, 4)))


def _sentences(rng: random.Random, least: int, most: int) -> str:
    words = [_word(rng) for _ in range(rng.randint(least, most))]
    return " ".join(w + rng.choice(("", "", "", "", "", "", ",", ".")) for w in words) + rng.choice((".", ".", ".", "", "!"))


def _links(rng: random.Random, least: int = 3, most: int = 9) -> str:
    form = rng.choice(("<ul>{}</ul>|<li>{}</li>", "{}|{} ", "<p>{}</p>|{} | ", "<ol>{}</ol>|<li>{}", "{}|<div>{}</div>")).split("|", 1)
    made = [form[1].format(f'<a href="/{_word(rng)}">{" ".join(_word(rng) for _ in range(rng.randint(1, 5)))}</a>') for _ in range(rng.randint(least, most))]
    return form[0].format("".join(made))


def _named(rng: random.Random, tags: tuple, names: tuple, always: bool = False) -> tuple[str, str]:
    """An opening and a closing tag; a telling name, more often on tags that tell nothing."""
    tag = rng.choice(tags)
    plain = tag in ("div", "section", "ul", "p")
    if always or rng.random() < (0.95 if plain else 0.4):
        name = rng.choice(names)
        if rng.random() < 0.3:
            name = rng.choice((f"{name}-{_word(rng)}", f"{_word(rng)} {name}", f"{name}-{rng.choice(('box', 'wrap', 'area', 'block'))}"))
        return f'<{tag} {rng.choice(("class", "class", "id"))}="{name}">', f"</{tag}>"
    return f"<{tag}>", f"</{tag}>"


# Layout parts: the tags and names such parts commonly have on public web pages.
def _furniture(rng: random.Random, kind: str) -> str:
    if kind == "nav":
        a, b = _named(rng, ("nav", "nav", "div", "ul"), ("nav", "menu", "navbar", "main-menu", "topbar", "breadcrumb", "breadcrumbs", "pagination"))
        return a + _links(rng) + b
    if kind == "header":
        a, b = _named(rng, ("header", "header", "div"), ("header", "masthead", "site-header", "top", "logo"))
        return a + rng.choice(("<h1>{}</h1>", "<p>{}</p>", "<a href='/'>{}</a>", "<div>{}</div>", "{}")).format(_sentences(rng, 1, 8)) + (_links(rng) if rng.random() < 0.5 else "") + b
    if kind == "footer":
        a, b = _named(rng, ("footer", "footer", "div"), ("footer", "site-footer", "copyright", "legal", "bottom"))
        return a + rng.choice(("&copy; {}", "<p>&copy; {}</p>", "<div>{}</div>", "<p>{}</p>")).format(_sentences(rng, 2, 25)) + (_links(rng) if rng.random() < 0.4 else "") + b
    if kind == "side":
        a, b = _named(rng, ("aside", "aside", "div", "section"), ("sidebar", "side", "widget", "related", "rail", "popular", "recommended", "links"))
        inner = "".join(rng.choice((f"<h3>{_sentences(rng, 1, 4)}</h3>", _links(rng), f"<p>{_sentences(rng, 5, 40)}</p>", _sentences(rng, 5, 30))) for _ in range(rng.randint(1, 4)))
        return a + inner + b
    if kind == "ad":
        a, b = _named(rng, ("div", "div", "aside", "section", "p"), ("ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "banner", "promo", "sponsor"), True)
        return a + rng.choice(("{}", "{}", "<p>{}</p>", "<a href='/x'>{}</a>", "<div><p>{}</p></div>")).format(_sentences(rng, 3, 40)) + b
    if kind == "notice":
        a, b = _named(rng, ("div", "div", "section", "aside", "p"), ("cookie", "cookie-notice", "notice", "consent", "alert", "gdpr", "popup", "disclaimer", "modal"), True)
        return a + rng.choice(("{}", "<p>{}</p>", "<p>{}</p><button>Ok</button>", "<div>{}</div>")).format(_sentences(rng, 4, 50)) + b
    if kind == "form":
        a, b = _named(rng, ("form", "form", "div"), ("newsletter", "subscribe", "signup", "login", "search", "contact", "form"))
        return a + f"<label>{_sentences(rng, 1, 4)}</label><input type=text>" + rng.choice(("", f"<p>{_sentences(rng, 4, 25)}</p>", f"<h3>{_sentences(rng, 2, 6)}</h3>")) + f"<button>{_word(rng)}</button>" + b
    if kind == "comments":
        a, b = _named(rng, ("div", "section", "ol", "ul"), ("comments", "comment-list", "replies", "discussion", "responses comments", "thread"), True)
        one = rng.choice(("<div class='comment'><b>{}</b><p>{}</p></div>", "<li><p>{}</p><p>{}</p></li>", "<p><b>{}</b> {}</p>", "<article class='comment'><header>{}</header><p>{}</p></article>"))
        return a + rng.choice(("", f"<h3>{_sentences(rng, 1, 3)}</h3>")) + "".join(one.format(_word(rng), _sentences(rng, 3, 60)) for _ in range(rng.randint(1, 6))) + b
    a, b = _named(rng, ("div", "ul", "p"), ("share", "social", "tags", "related", "follow", "tools"), True)
    return a + _links(rng, 2, 6) + b


def _article(rng: random.Random) -> str:
    text = lambda least, most: MARK + _sentences(rng, least, most)
    parts = [f"<h1>{text(2, 14)}</h1>"] if rng.random() < 0.8 else []
    many = rng.choice((1, 2, 3, 5, 8, 14))
    for i in range(many):
        kind = rng.random()
        if kind < 0.70:
            part = f"<p>{text(*rng.choice(((1, 4), (3, 20), (15, 90), (40, 160))))}</p>"
        elif kind < 0.76:
            part = f"<p><b>{text(5, 40)}<br>" if rng.random() < 0.5 else f"<p>{text(5, 40)}"
        elif kind < 0.82:
            part = f"<h2>{text(1, 8)}</h2>"
        elif kind < 0.87:
            part = "<ul>" + "".join(f"<li>{text(1, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        elif kind < 0.90:
            part = f"<blockquote>{rng.choice(('{}', '<p>{}</p>')).format(text(8, 50))}</blockquote>"
        elif kind < 0.93:
            part = "<table>" + "".join(f"<tr><td>{text(1, 4)}</td><td>{text(1, 4)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        elif kind < 0.96:
            part = f"<div>{text(10, 80)}</div>"
        else:
            part = f"<p>{text(5, 30)} <a href='/y'>{_word(rng)} {_word(rng)}</a> {_sentences(rng, 4, 20)}</p>"
        parts.append(part)
        if i + 1 < many and rng.random() < 0.08:
            parts.append(_furniture(rng, rng.choice(("ad", "share", "form", "notice", "side"))))
    if rng.random() < 0.15:
        parts.append(_furniture(rng, rng.choice(("share", "comments", "form", "footer", "side"))))
    a, b = _named(rng, ("article", "article", "article", "main", "div", "div", "section"), ("content", "post", "entry", "article", "article-body", "story", "main-content", "post-content", "body", "text"))
    made = a + "".join(parts) + b
    while rng.random() < 0.35:
        a, b = _named(rng, ("main", "div", "section"), ("main", "container", "page", "wrapper", "content", "row"))
        made = a + made + b
    return made


def generated_page(rng: random.Random) -> str:
    """A page of a random layout; each run of the article's text starts with MARK."""
    top = [k for k in ("header", "nav", "notice", "ad", "nav", "form") if rng.random() < 0.45]
    rest = [k for k in ("side", "ad", "comments", "share", "form", "side", "notice", "nav") if rng.random() < 0.35]
    if rng.random() < 0.85:
        rest.append("footer")
    if rng.random() < 0.2:
        rng.shuffle(top)
    side_first = rng.random() < 0.2
    made = [_furniture(rng, k) for k in top]
    after = [_furniture(rng, k) for k in rest]
    if side_first and after:
        made.append(after.pop(0))
    if rng.random() < 0.93:
        made.append(_article(rng))
    body = "".join(made + after)
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(("container", "page", "wrapper", "row", "layout"))}">{body}</div>'
    return f"<html><head><title>{_sentences(rng, 2, 9)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    told = pages.sparkSession.sparkContext.broadcast(fit())

    def make():
        trees = kept_in_worker(("page_text",), lambda: told.value)

        def work(rows):
            texts = extract([r[2] or "" for r in rows], trees)
            return {"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "text": texts, "n_chars": list(map(len, texts))}

        return work

    kinds = dict(pages.dtypes)
    kept = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return map_texts(kept, make, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint", SLICE_BYTES)
