"""Main text of web pages by a tree-structured graphical model.

The DOM of a page is a tree of binary variables: an element or a run of text is content or not. A variable has a potential
from its own features (tag, words of class, id and role, size and link share of its text, marks in it), and each
parent-child edge has a potential by the kinds of both. Sum-product messages go upward and downward once, which gives the exact
marginals; text with a content marginal over a half is kept. The parameters are fitted by maximum likelihood
(observed minus expected features) on labelled pages, which ``labelled_pages`` lays out from many kinds of regions.

Pages of an Arrow batch form forests of at most ``GROUP_CHARS`` characters of html (one page at least), and messages are computed
level by level in numpy.

Text handling: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by one space. Comments, scripts, styles and the head hold no text.

Defined cases: null or empty html gives an empty text; repeated rows give equal texts, a row each; unclosed and
unknown tags are taken as browsers do as far as blocks are concerned; the text of formulas (math) counts like other text, that of drawings
(svg) does not; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm import arrays as A
from skyquill.llm.common import small_batches, table

BUCKETS = 1 << 12
BATCH_PAGES = 128
GROUP_CHARS = 1 << 20

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset(("body", "head", "html", "button", "legend", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "select"))
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",),
}
SCOPES = frozenset(("ul", "ol", "dl", "table", "select", "html", "body", "article", "section", "div", "td", "th", "button"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

TEXT, INLINE, BLOCK, SECTION = range(4)
_SECTIONS = frozenset("article aside div footer form header html body main nav section table ul ol".split())


class Tree:
    """Nodes in page order; a parent comes before its children."""

    __slots__ = ("parent", "kind", "name", "words", "text", "block")

    def __init__(self):
        self.parent, self.kind, self.name, self.words, self.text, self.block = [-1], [SECTION], ["#page"], [()], [""], [0]

    def add(self, parent, kind, name, words, text, block):
        self.parent.append(parent)
        self.kind.append(kind)
        self.name.append(name)
        self.words.append(words)
        self.text.append(text)
        self.block.append(block)
        return len(self.parent) - 1


def parse(page: str) -> Tree:
    tree, stack, block, at, size = Tree(), [0], 0, 0, len(page)

    def text(piece):
        if piece:
            tree.add(stack[-1], TEXT, "#text", (), html.unescape(piece), block)

    def close_to(depth):
        del stack[depth:]

    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            tree.add(stack[-1], TEXT, "#text", (), " ", block)
            continue
        is_block = name in BLOCKS
        if is_block:
            block += 1
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if tree.name[stack[i]] == name:
                    close_to(i)
                    break
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                n = tree.name[stack[i]]
                if n == "p":
                    close_to(i)
                    break
                if n in SCOPES:
                    break
        if name in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                n = tree.name[stack[i]]
                if n in SIBLINGS[name]:
                    close_to(i)
                elif n in SCOPES:
                    break
        if name in RAW and not (name == "svg" and (found[3] or "").endswith("/")):
            end = _CLOSE[name].search(page, at)
            at = end.end() if end else size
            continue
        words = ()
        if found[3]:
            words = tuple(w for m in _NAMES.finditer(found[3]) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower()))
        kind = SECTION if name in _SECTIONS else BLOCK if is_block else INLINE
        node = tree.add(stack[-1], kind, name, words, "", block)
        if name not in VOID and not (found[3] or "").endswith("/"):
            stack.append(node)
    return tree


_hashes: dict[str, int] = {}


def _bucket(name: str) -> int:
    got = _hashes.get(name)
    if got is None:
        h = 2166136261
        for c in name.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        got = (h ^ (h >> 15)) % BUCKETS
        if len(_hashes) < 200_000:
            _hashes[name] = got
    return got


def features(tree: Tree) -> tuple[list[int], list[int]]:
    """(node, bucket) of every feature."""
    n = len(tree.parent)
    size, linked, leaves = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.name[i] == "a"
        if tree.kind[i] == TEXT:
            size[i] = len(tree.text[i].strip())
            linked[i] = size[i] if in_link[i] else 0
            leaves[i] = 1 if size[i] else 0
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
        leaves[p] += leaves[i]
    nodes, buckets = [], []
    for i in range(n):
        kind, length = tree.kind[i], size[i]
        own = [f"k{kind}"]
        scale = min(length.bit_length(), 12)
        share = 0 if not length else 1 + int(3.99 * linked[i] / length)
        if i and tree.name[i] not in ("html", "body"):  # how long a page is says nothing of whether it has an article
            own.append(f"s{kind}.{scale}")
            own.append(f"l{kind}.{share}")
        if kind == TEXT:
            parent = tree.name[tree.parent[i]]
            own.append(f"p{parent}")
            if "©" in tree.text[i] or "(c)" in tree.text[i]:
                own.append("copyright")
        else:
            own.append(f"t{tree.name[i]}")
            if tree.name[i] not in ("#page", "html", "body"):
                own.append(f"m{kind}.{min((length // max(1, leaves[i])).bit_length(), 9)}")
            own += [f"w{w}" for w in tree.words[i]] or [f"unnamed {tree.name[i]}"]
        nodes += [i] * len(own)
        buckets += map(_bucket, own)
    return nodes, buckets


class Forest:
    """Many trees as one set of arrays."""

    def __init__(self, trees: list[Tree]):
        parents, kinds, nodes, buckets, first, at = [], [], [], [], [], 0
        for tree in trees:
            first.append(at)
            n = len(tree.parent)
            p = np.array(tree.parent)
            parents.append(np.where(p >= 0, p + at, -1))
            kinds.append(np.array(tree.kind))
            a, b = features(tree)
            nodes.append(np.array(a) + at)
            buckets.append(np.array(b))
            at += n
        self.parent, kind = np.concatenate(parents), np.concatenate(kinds)
        #: kind of child and of parent
        self.edge = 4 * kind + kind[np.maximum(self.parent, 0)]
        self.node, self.bucket, self.first, self.size = np.concatenate(nodes), np.concatenate(buckets), first, at
        depth = np.zeros(at, dtype=np.int64)
        todo = self.parent.copy()
        while (live := todo >= 0).any():
            depth[live] += 1
            todo[live] = self.parent[todo[live]]
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
        self.levels = np.split(order, cut)[:-1]


def marginals(forest: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(content) by node, P(parent state, node state) by node) by sum-product.

    ``weights``: log potential of content by bucket. ``edges[e, a, b]``: log potential of parent state a
    and child state b, by the kinds of both.
    """
    up = np.zeros((forest.size, 2))
    up[:, 1] = np.bincount(forest.node, weights=weights[forest.bucket], minlength=forest.size)
    message = np.zeros((forest.size, 2))
    for level in forest.levels[:0:-1]:
        joint = edges[forest.edge[level]] + up[level][:, None, :]
        message[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        for s in (0, 1):
            up[:, s] += np.bincount(forest.parent[level], weights=message[level, s], minlength=forest.size)
    belief = up.copy()
    pair = np.zeros((forest.size, 2, 2))
    for level in forest.levels[1:]:
        outside = belief[forest.parent[level]] - message[level]
        joint = edges[forest.edge[level]] + outside[:, :, None]
        belief[level] += np.logaddexp(joint[:, 0, :], joint[:, 1, :])
        joint = joint + up[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pair[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pair


def fit(trees: list[Tree], labels: list[np.ndarray], steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by gradient steps (Adam): observed minus expected features."""
    forest, y = Forest(trees), np.concatenate(labels).astype(float)
    weights, edges = np.zeros(BUCKETS), np.zeros((16, 2, 2))
    has = forest.parent >= 0
    seen = np.zeros((16, 2, 2))
    np.add.at(seen, (forest.edge[has], y[forest.parent[has]].astype(int), y[has].astype(int)), 1)
    flat = np.zeros(BUCKETS + 64)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        p, pair = marginals(forest, weights, edges)
        gw = np.bincount(forest.bucket, weights=(y - p)[forest.node], minlength=BUCKETS)
        ge = seen.copy()
        for a in (0, 1):
            for b in (0, 1):
                ge[:, a, b] -= np.bincount(forest.edge[has], weights=pair[has, a, b], minlength=16)
        grad = np.concatenate([gw, ge.ravel()]) / len(trees) - 3e-4 * flat
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        flat += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, edges = flat[:BUCKETS], flat[BUCKETS:].reshape(16, 2, 2)
    return weights, edges


MARK = "␟"  # in front of each content word of the labelled pages


def labelled_pages(n: int, seed: int = 3) -> list[str]:
    """Pages whose content words start with MARK, laid out from regions of many kinds."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p

    def words(k, mark=""):
        return " ".join(mark + "".join(pick("abcdeghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(k))

    def sentence(mark="", low=2, high=30):
        return words(rng.randint(low, high), mark).capitalize() + pick([".", ".", ".", "?", "!", ""])

    def prose(mark="", low=1, high=6):
        return " ".join(sentence(mark, 1) for _ in range(rng.randint(low, high)))

    def attr(*names):
        return "" if chance(0.12) else f' {pick(["class", "class", "id"])}="{pick(["", "", "page-", "site_", "x "])}{pick(names)}{pick(["", "", "", "-inner", " clearfix", "-1"])}"'

    def links(low, high):
        return [f'<a href="/{words(1)}">{words(rng.randint(1, 4))}</a>' for _ in range(rng.randint(low, high))]

    def menu():
        items = links(3, 9)
        inner = pick([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<span>{x}</span>" for x in items)])()
        return pick([f"<nav>{inner}</nav>", f"<nav{attr('main-nav', 'menu')}>{inner}</nav>", f"<div class=\"{pick(['menu', 'navbar', 'nav', 'breadcrumbs', 'breadcrumb', 'topnav', 'navigation', 'pagination'])}\">{inner}</div>"])

    def header():
        inner = pick([f"<a href='/'>{words(2)}</a>", f"<h1>{words(2)}</h1>", f"<p>{sentence()}</p>", f"<h2>{words(3)}</h2><p>{words(5)}</p>"]) + (menu() if chance(0.4) else "")
        return pick([f"<header>{inner}</header>", f"<header{attr('site-header')}>{inner}</header>", f"<div class=\"{pick(['header', 'masthead', 'topbar', 'banner', 'branding', 'logo'])}\">{inner}</div>"])

    def box(tags, names, inner):
        tag = pick(tags)
        named = f' {pick(["class", "class", "id"])}="{pick(["", "", "box ", "widget-", "site-"])}{pick(names)}"'
        return f"<{tag}{named if tag in ('div', 'section', 'ol', 'ul', 'p', 'span') or chance(0.5) else ''}>{inner}</{tag}>"

    def advert():
        return box(["div", "div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "adbox", "sponsor", "sponsored", "promo", "banner", "promotion"], pick([prose(), sentence(), f"<p>{prose()}</p>", links(1, 1)[0], f"<a href='/x'>{sentence()}</a>"]))

    def notice():
        return box(["div", "div", "section", "p"], ["notice", "cookie", "cookies", "consent", "alert", "newsletter", "subscribe", "popup", "modal", "disclaimer", "gdpr", "message", "warning", "paywall"], pick([sentence(), prose(), f"<p>{prose()}</p><button>{words(1)}</button>"]) if chance(0.8) else sentence() + links(1, 1)[0])

    def form():
        fields = "".join(f"<label>{words(2)}</label><input name='a'>" for _ in range(rng.randint(1, 3)))
        body = f"<form{attr('search', 'login', 'signup', 'contact')}>{pick(['', f'<p>{sentence()}</p>', f'<h3>{words(3)}</h3>'])}{fields}{pick(['', '<select><option>' + words(1) + '<option>' + words(2) + '</select>'])}<button>{words(1)}</button></form>"
        return body if chance(0.6) else box(["div"], ["search", "login", "signup", "subscribe", "form"], body)

    def sidebar():
        inner = pick(["", f"<h3>{words(2)}</h3>"]) + pick([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in links(2, 7)) + "</ul>", lambda: f"<p>{prose()}</p>", lambda: prose(), lambda: "".join(f"<div>{x}</div>" for x in links(2, 5))])()
        return box(["aside", "div", "div", "section"], ["sidebar", "side", "related", "widget", "recommended", "popular", "trending", "tags", "rail", "recent", "secondary", "author", "bio", "toc"], inner)

    def share():
        return box(["div", "ul", "p"], ["share", "social", "sharing", "meta", "byline", "tags", "buttons"], " ".join(links(1, 5)))

    def footer():
        inner = pick([f"&copy; {words(3)} &middot; {sentence()}", f"<p>&copy; 2020 {words(2)}</p>", prose(), "<ul>" + "".join(f"<li>{x}</li>" for x in links(2, 6)) + "</ul>", f"<p>{prose()}</p>"])
        return f"<footer>{inner}</footer>" if chance(0.6) else box(["div", "footer"], ["footer", "foot", "colophon", "copyright", "bottom", "legal"], inner)

    def comments():
        one = lambda: pick([f"<p>{prose()}</p>", f"<div class='{pick(['comment', 'comment-body', 'reply'])}'><b>{words(1)}</b><p>{prose()}</p></div>", f"<li>{prose()}</li>", f"<article class='comment'><p>{prose()}</p></article>", f"<div>{prose()}</div>"])
        inner = pick(["", f"<h2>{words(2)}</h2>", f"<h3>{words(1)}</h3>"]) + "".join(one() for _ in range(rng.randint(1, 5)))
        return box(["div", "section", "section", "ol", "ul"], ["comments", "comment", "commentlist", "discussion", "replies", "responses", "disqus", "thread", "comment-section"], inner) if chance(0.95) else f"<section id='comments'>{inner}</section>"

    def inline(text):
        if chance(0.25) and " " in text:
            a, b = text.split(" ", 1)
            tag = pick(["b", "em", "strong", "a href='/x'", "span", "code", "i"])
            return f"<{tag}>{a}</{tag.split()[0]}> {b}"
        return text

    def block(deep=0):
        kind = rng.random()
        if deep < 3 and chance(0.1):  # containers without a meaning, or with a name of layout
            return f"<div{pick(['', attr('row', 'col', 'inner', 'wrap', 'block', 'container')])}>" + "".join(block(deep + 1) for _ in range(rng.randint(1, 4))) + "</div>"
        if chance(0.05):  # a paragraph that is one link
            return pick([f"<p><a href='/x'>{pick([prose, sentence])(MARK)}</a></p>", f"<p><a href='/x'><b>{sentence(MARK)}</b></a></p>", f"<div><a href='/x'>{prose(MARK)}</a></div>", f"<h2><a href='/x'>{words(rng.randint(2, 8), MARK)}</a></h2>"])
        if kind < 0.62:
            text = inline(prose(MARK) if chance(0.8) else sentence(MARK, 1, 3))
            if chance(0.2):
                text = "<br>".join(inline(sentence(MARK, 1, 5)) for _ in range(rng.randint(2, 3))) + inline(" " + words(2, MARK))
            return pick([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p{attr('lead', 'text', 'intro')}>{text}</p>", f"<div>{text}</div>"])
        if kind < 0.72:
            h = pick(["h2", "h3", "h4"])
            return f"<{h}>{words(rng.randint(1, 8), MARK)}</{h}>"
        if kind < 0.8:
            tag = pick(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{inline(sentence(MARK))}</li>" for _ in range(rng.randint(2, 5))) + f"</{tag}>"
        if kind < 0.85:
            return f"<blockquote><p>{prose(MARK)}</p></blockquote>"
        if kind < 0.89:
            return f"<pre>{words(6, MARK)}\n{words(4, MARK)}</pre>"
        if kind < 0.93:
            return "<table><tr>" + "".join(f"<td>{words(2, MARK)}</td>" for _ in range(3)) + "</tr></table>"
        if kind < 0.96:
            return f"<figure><img src='a'><figcaption>{sentence(MARK)}</figcaption></figure>"
        return f"<section><h2>{words(3, MARK)}</h2><p>{prose(MARK)}</p></section>"

    def article():
        parts = [f"<h1>{words(rng.randint(1, 12), MARK)}</h1>"] if chance(0.75) else []
        for _ in range(rng.choice([0, 1, 2, 4, 8, 14])):
            parts.append(block())
            if chance(0.08):
                parts.append(pick([advert, advert, share, notice, sidebar, form])())
        if chance(0.1):
            parts.append(comments())
        if chance(0.08):
            parts.append(f"<footer>{pick([words(4), sentence()])}</footer>")
        inner = "".join(parts)
        if chance(0.16):  # a text alone, or without any container of its own
            return pick([f"<div>{prose(MARK, 2, 9)}</div>", f"<p>{prose(MARK, 2, 9)}</p>", f"<div><div>{prose(MARK, 2, 9)}</div></div>", f"<div>{inline(prose(MARK, 2, 9))}<br><br>{prose(MARK)}</div>", inner, inner, f"<div>{inner}</div>"])
        tag = pick(["article", "article", "article", "div", "main", "section"])
        named = f' {pick(["class", "id"])}="{pick(["content", "post", "entry", "article", "story", "main", "text", "article-body", "post-content", "entry-content", "body", "page-content"])}"'
        out = f"<{tag}{named if tag in ('div', 'section') or chance(0.3) else ''}>{inner}</{tag}>"
        return f"<main>{out}</main>" if chance(0.2) else out

    pages = []
    for _ in range(n):
        before = [f() for f in (header, menu, notice, advert, form, sidebar) if chance(0.35)]
        rng.shuffle(before)
        after = [f() for f in (comments, sidebar, advert, share, form, notice) if chance(0.3)]
        rng.shuffle(after)
        if chance(0.15):  # nothing but the text
            before, after = [], []
        middle = [article(), *after]
        if before and chance(0.25):
            middle.insert(0, sidebar())
        inner = "".join(middle)
        for _ in range(rng.choice([0, 0, 1, 2])):
            inner = f"<div{attr('wrapper', 'container', 'page', 'row', 'col', 'layout')}>{inner}</div>"
        body = "".join(before) + inner + (footer() if chance(0.8 if before else 0.3) else "")
        pages.append(f"<!DOCTYPE html><html><head><title>{words(3)}</title><script>var t='<p>';</script></head><body{attr('home', 'single')}>{body}" + ("</body></html>" if chance(0.9) else ""))
    return pages


def tree_labels(tree: Tree) -> np.ndarray:
    """1 for text that holds MARK, and for every element over such text."""
    y = np.zeros(len(tree.parent), dtype=np.int64)
    for i in range(len(y) - 1, -1, -1):
        if MARK in tree.text[i]:
            y[i] = 1
        if y[i] and i:
            y[tree.parent[i]] = 1
    return y


def default_model(pages: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Parameters fitted on laid-out pages."""
    trees = [parse(p) for p in labelled_pages(pages)]
    labels = [tree_labels(t) for t in trees]
    for t in trees:
        t.text = [x.replace(MARK, "") for x in t.text]
    return fit(trees, labels)


def assemble(tree: Tree, content: np.ndarray) -> str:
    """Blocks of content text in page order. White space between pieces of one block counts whatever its node's marginal."""
    blocks, current, last = [], [], None
    for i in range(1, len(tree.parent)):
        if tree.kind[i] != TEXT:
            continue
        if tree.block[i] != last:
            blocks.append("".join(current))
            current, last = [], tree.block[i]
        if content[i] > 0.5 or tree.text[i].isspace():
            current.append(tree.text[i])
    blocks.append("".join(current))
    return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model=None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    spark = df.sparkSession
    small_batches(spark, BATCH_PAGES)
    held = spark.sparkContext.broadcast(model or default_model())  # BUCKETS weights at any size of the input

    def run(batches):
        weights, edges = held.value
        for batch in batches:
            texts, pages, size = [], [], 0

            def flush():
                trees = [parse(p) for p in pages]  # noqa: B023
                forest = Forest(trees)
                p, _ = marginals(forest, weights, edges)
                return [assemble(t, p[at : at + len(t.parent)]) for t, at in zip(trees, forest.first)]

            for page in batch.column(2):
                page = page.as_py() or ""
                if pages and size + len(page) > GROUP_CHARS:
                    texts += flush()
                    pages, size = [], 0
                pages.append(page)
                size += len(page)
            texts += flush() if pages else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(A.task(run), f"page_id {kind}, url string, text string, n_chars long")


def op3_tree_model_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
