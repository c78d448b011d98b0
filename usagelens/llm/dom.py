"""A tolerant reader of HTML: the block elements of pages as flat arrays, with features of each.

Only what main-text extraction needs: block elements in page order with their
parents, and the runs of inline text that stand directly in them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import numpy as np

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title noscript template textarea svg iframe select option object canvas math".split())
#: Of these everything up to the end tag is text, and the rest of the page if there is none.
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head button legend label".split()
)
#: An opening tag ends open elements of these kinds, up to the nearest of the kinds after the bar.
ENDS = {
    **{k: (frozenset({"p"}), frozenset({"button", "td", "th", "table"})) for k in BLOCKS - {"html", "body", "head", "button", "label", "td", "th", "tr", "tbody", "thead", "tfoot"}},
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
TAG_KINDS = (
    ("article", "main"), ("section", "div", "center"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"),
    ("ul", "ol", "menu", "dl", "dir"), ("li", "dd", "dt"), ("table", "tbody", "thead", "tfoot", "tr"), ("td", "th"), ("nav",), ("header",),
    ("footer", "address"), ("aside",), ("form", "fieldset", "button", "label", "legend"), ("figure", "figcaption"), ("html", "body"),
)
KIND_OF = {tag: i for i, tags in enumerate(TAG_KINDS) for tag in tags}
#: Words in class, id and role attributes, by what they tell.
TOKEN_KINDS = (
    "content article post entry main story body text page prose",
    "nav menu navbar navigation topbar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "sidebar side aside rail widget related recommended more popular trending tags promo links archive",
    "ad ads advert adverts advertisement banner sponsor sponsored dfp adsense",
    "cookie cookies consent gdpr notice alert notification popup modal overlay banner disclaimer warning toast",
    "comment comments reply replies respond discussion disqus reactions thread feedback",
    "form newsletter subscribe subscription signup login search contact input",
    "footer foot copyright legal bottom colophon credits",
    "header head masthead logo brand tagline site hero top",
    "share social follow author byline meta date rating print tools",
)
TOKEN_OF = {word: 0 for kind in TOKEN_KINDS for word in kind.split()}
for _i, _kind in enumerate(TOKEN_KINDS):
    for _word in _kind.split():
        TOKEN_OF[_word] |= 1 << _i

#: A comment, a declaration, a tag whose quoted values may hold >, or failing that anything up to the next >.
#: Outside quotes a < ends the search for the former, so a stray quote doesn't send it through the page.
_TAG = re.compile(
    r"""<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_END: dict[str, re.Pattern] = {tag: re.compile(rf"</{tag}[^>]*>", re.I) for tag in SKIPPED}


def _tokens(attributes: str) -> int:
    mask = 0
    for found in _NAMED.findall(attributes):
        for word in _PART.findall(_CAMEL.sub(r"\1 \2", "".join(found)).lower()):
            mask |= TOKEN_OF.get(word, 0)
    return mask


class Pages:
    """Block elements of several pages behind each other. Node 0 of each page is its root."""

    def __init__(self):
        self.page_start: list[int] = []
        self.parent: list[int] = []
        self.kind: list[int] = []
        self.tokens: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []  # the first node after each subtree
        self.first_run: list[int] = []  # the first run in each subtree or after it
        self.run_node: list[int] = []
        self.run_text: list[str] = []
        self.run_linked: list[int] = []
        self.run_marks: list[int] = []

    def add(self, source: str) -> None:
        """Read one page, in time that is linear in its length."""
        root = self._node(-1, -1, 0, 0)
        self.page_start.append(root)
        stack: list[tuple[str, int]] = [("", root)]  # (tag, its block node or that of the block around it)
        opened: dict[str, list[int]] = {}  # where each tag stands in the stack
        pieces: list[str] = []
        state = [0, 0, 0]  # links open, linked characters, inline tags of the run
        at, last = 0, source.rfind(">") + 1  # no tag ends after the last >
        unended: set[str] = set()  # skipped tags that have no end tag from here on

        def end_run() -> None:
            text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
            if text:
                self.run_node.append(stack[-1][1])
                self.run_text.append(text)
                self.run_linked.append(min(state[1], len(text)))
                self.run_marks.append(state[2])
            pieces.clear()
            state[1] = state[2] = 0

        def close_to(depth: int) -> None:
            for tag, node in stack[depth:]:
                state[0] -= tag == "a"
                opened[tag].pop()
                if tag in BLOCKS:
                    self.end[node] = len(self.parent)
            del stack[depth:]

        def push(tag: str, node: int) -> None:
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))

        def text(piece: str) -> None:
            pieces.append(piece)
            if state[0]:
                state[1] += len(piece.strip())

        while m := _TAG.search(source, at, last):
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            if m.group() == "<!--":  # up to its end, or all the rest
                found = source.find("-->", at)
                at = found + 3 if found >= 0 else len(source)
                continue
            name = m.group(2) or m.group(5)
            if not name:
                continue
            tag, closing = name.lower(), m.group(1) or m.group(4)
            if closing:
                if tag in VOID:
                    continue
                if opened.get(tag):
                    depth = opened[tag][-1]
                    if any(t in BLOCKS for t, _ in stack[depth:]):
                        end_run()
                    close_to(depth)
                continue
            if tag in SKIPPED:
                closed = tag in ("svg", "math") and (m.group(3) or m.group(6) or "").rstrip().endswith("/")
                found = None if closed or tag in unended else _END[tag].search(source, at, last)
                if found:
                    at = found.end()
                elif tag in RAW:
                    at = len(source)
                elif not closed:
                    unended.add(tag)
                pieces.append(" ")
                continue
            if tag in VOID:
                pieces.append(" ")
                if tag == "hr":
                    end_run()
                continue
            attributes = m.group(3) or m.group(6) or ""
            if tag not in BLOCKS:
                state[2] += 1
                state[0] += tag == "a"
                if not attributes.rstrip().endswith("/"):
                    push(tag, stack[-1][1])
                else:
                    state[0] -= tag == "a"
                continue
            end_run()
            ended, within = ENDS.get(tag, (frozenset(), frozenset()))
            barrier = max((opened[t][-1] for t in within if opened.get(t)), default=0)
            above = ((where, bisect_right(where, barrier)) for t in ended if (where := opened.get(t)))
            close_to(min((where[i] for where, i in above if i < len(where)), default=len(stack)))
            around = stack[-1][1]
            if tag in ("html", "body") and opened.get(tag):
                continue
            node = self._node(around, KIND_OF.get(tag, 1) if tag != "head" else len(TAG_KINDS), _tokens(attributes) if attributes else 0, self.depth[around] + 1)
            push(tag, node)
        if at < len(source):
            text(source[at:])
        end_run()
        close_to(1)
        self.end[root] = len(self.parent)

    def _node(self, parent: int, kind: int, tokens: int, depth: int) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.tokens.append(tokens)
        self.depth.append(depth)
        self.end.append(0)
        self.first_run.append(len(self.run_text))
        return len(self.parent) - 1


class Tree:
    """The pages as arrays, with sums over subtrees."""

    def __init__(self, pages: Pages):
        self.parent = np.array(pages.parent, dtype=np.int64)
        self.kind = np.array(pages.kind, dtype=np.int64)
        self.own_tokens = np.array(pages.tokens, dtype=np.int64)
        self.depth = np.array(pages.depth, dtype=np.int64)
        self.run_node = np.array(pages.run_node, dtype=np.int64)
        self.start = np.array(pages.page_start, dtype=np.int64)
        size = len(self.parent)
        self.page = np.zeros(size, dtype=np.int64)
        self.page[self.start] = 1
        self.page = np.cumsum(self.page) - 1
        self.end = np.array(pages.end, dtype=np.int64)

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree, whose nodes are those up to its end."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[self.end] - total[:-1]

    def down(self, masks: np.ndarray) -> np.ndarray:
        """Bits of each node and all nodes around it."""
        out = np.zeros_like(masks)
        for bit in range(int(masks.max(initial=0)).bit_length()):
            nodes = np.flatnonzero(masks >> bit & 1)
            if len(nodes):
                inside = np.bincount(nodes, minlength=len(masks) + 1) - np.bincount(self.end[nodes], minlength=len(masks) + 1)
                out |= (np.cumsum(inside)[:-1] > 0).astype(masks.dtype) << bit
        return out


def features(pages: Pages, tree: Tree) -> np.ndarray:
    """A row of numbers for each node: what it is, what it holds, where it stands."""
    size = len(tree.parent)
    texts = pages.run_text
    length = np.fromiter(map(len, texts), dtype=np.float64, count=len(texts))
    words = np.fromiter((t.count(" ") + 1 for t in texts), dtype=np.float64, count=len(texts))
    signs = np.fromiter((t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts), dtype=np.float64, count=len(texts))
    at = lambda values: np.bincount(tree.run_node, weights=values, minlength=size) if len(texts) else np.zeros(size)
    own = at(length)
    chars, word, linked = tree.up(own), tree.up(at(words)), tree.up(at(np.array(pages.run_linked, dtype=np.float64)))
    runs, sign, marks = tree.up(at(np.ones(len(texts)))), tree.up(at(signs)), tree.up(at(np.array(pages.run_marks, dtype=np.float64)))
    nodes = tree.up(np.ones(size))
    paragraphs = tree.up((tree.kind == 2).astype(np.float64))
    around = np.where(tree.parent >= 0, tree.parent, np.arange(size))
    whole = chars[tree.start][tree.page]
    first = np.zeros(size)  # characters of the page before the node
    if len(texts):
        before = np.concatenate([[0], np.cumsum(length)])
        place = np.array(pages.first_run)
        first = before[place] - before[place[tree.start]][tree.page]
    siblings = np.bincount(around, minlength=size)[around]
    alike = _counts(around * 64 + tree.kind)
    kinds = 1 << np.clip(tree.kind, 0, 30)
    kinds[tree.kind < 0] = 0
    outer_kinds, outer_tokens = tree.down(kinds)[around], tree.down(tree.own_tokens)[around]
    columns = [
        np.log1p(chars), np.log1p(word), np.log1p(own), linked / np.maximum(chars, 1), sign / np.maximum(word, 1), chars / np.maximum(nodes, 1),
        word / np.maximum(runs, 1), np.log1p(runs), np.log1p(paragraphs), np.log1p(nodes), marks / np.maximum(word, 1),
        tree.depth, chars / np.maximum(whole, 1), chars / np.maximum(chars[around], 1), first / np.maximum(whole, 1), np.log1p(siblings), np.log1p(alike),
        linked[around] / np.maximum(chars[around], 1), np.log1p(paragraphs[around]),
    ]
    columns += [tree.kind == k for k in range(len(TAG_KINDS))]
    columns += [(tree.own_tokens >> k) & 1 for k in range(len(TOKEN_KINDS))]
    columns += [(outer_kinds >> k) & 1 for k in (0, 2, 4, 8, 9, 10, 11, 12)]
    columns += [(outer_tokens >> k) & 1 for k in range(len(TOKEN_KINDS))]
    return np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1)


def _counts(keys: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse]

