"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded down the tree.

Each node gets features of its tag, attribute tokens, depth, siblings, neighbours and subtree (text, links, punctuation,
density, and how it stands to the densest container of prose). Spark ML's boosted trees give its probability of being
main content. Decoding picks the most likely labelling in which no kept node stands below a dropped one: from
the leaves up, a node's best kept score lets each child choose, its best dropped score takes all descendants as
dropped; then choices are read from the root down. The page's frame (html, body) is always kept, what no reader sees
(scripts, styles, the head, hidden elements) always dropped.

There are no labelled pages, so the trees learn from pages of known construction. The words and articles of
a bounded sample (TRAIN_PAGES of smallest hash) are put into made layouts: articles of paragraphs,
headings, lists, tables, quotes and wrappers, among menus, headers, footers, sidebars, notices, adverts, forms and
comments. Elements carry telling tags or names, names that tell nothing, or none, so neither names nor
form alone decide; every element's label is known from how it was made. The sampled pages themselves take part too
where they have an article element.

Without any page (such as in an empty table), names alone decide.

Defined results: null and empty html give the empty text and 0 characters. Markup without any kept node
gives the empty text. Broken markup is read as far as it goes, very long pages are read whole. Repeated rows repeat.
Only page_id, url and html are read, whatever other columns there are.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm.common import Sent, table, written
from provisio.llm.dom import Page

TRAIN_PAGES = 200  # the bound of the sample
MADE = 5  # layouts for each sampled page
ROUNDS = 18
DEPTH = 5
# Tokens of tags, classes, ids and roles.
NEGATIVE = {
    "menu": {"nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs"},
    "edge": {"header", "footer", "masthead", "topbar", "copyright", "legal", "contentinfo"},
    "side": {"aside", "sidebar", "rail", "widget", "related", "recommended", "trending", "complementary"},
    "notice": {"notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "disclaimer", "toast"},
    "advert": {"ad", "ads", "advert", "advertisement", "adverts", "sponsor", "sponsored", "promo", "promotion", "banner", "commercial"},
    "form": {"form", "input", "button", "select", "textarea", "search", "login", "signup", "fieldset", "option"},
    "reader": {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "commentlist", "responses"},
    "share": {"share", "sharing", "social"},
}
# Tokens that stand in names of both kinds.
EITHER = ["bottom", "top", "side", "site", "message", "warning", "tags", "meta", "author", "byline", "label", "popular", "follow", "rating", "reader", "feedback", "box", "block", "inner", "wrap"]
POSITIVE = {"article", "main", "content", "post", "entry", "story", "text", "articlebody", "prose", "maincontent"}
UNSEEN = {"script", "style", "noscript", "template", "iframe", "head", "title", "meta", "link", "svg", "canvas", "object"}
FRAME = {"#root", "html", "body"}
TEXT_TAGS = {"p", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "dl", "table", "tbody", "tr"}
BOXES = {"div", "section", "center", "span"}
INNER = {"b", "i", "em", "strong", "br", "u", "code", "sup", "sub", "small"}
CONTROLS = {"input", "button", "select", "textarea", "option", "label"}
NAMES = (
    *NEGATIVE, "either", "positive", "in_positive", "in_negative", "unseen", "text_tag", "head_tag", "list_tag", "box_tag", "inner_tag", "link_tag", "control_tag", "frame_tag",
    "depth", "siblings", "place", "size", "density", "links", "children", "subtree", "parent_links", "share", "parent_share", "punctuation", "parent_punctuation", "prose", "longest", "paragraphs", "heads", "controls",
    "before", "after", "previous", "next", "same", "in_best", "has_best", "best_share", "mean_words", "link_count",
)
COL = {name: k for k, name in enumerate(NAMES)}
SEP = re.compile(r"[.,;:!?]")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def tokens(tag: str, attrs: dict[str, str]) -> set[str]:
    found = {tag}
    for a in ("class", "id", "role", "itemprop", "aria-label"):
        if v := attrs.get(a):
            found.update(SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", v).lower()))
    if "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", ""):
        found.add("hidden")
    return found


def features(page: Page) -> np.ndarray:
    """A row for each node, columns as in NAMES."""
    n, parent, tags = len(page.tags), page.parent, page.tags
    x = np.zeros((n, len(NAMES)), np.float32)
    flag = [[] for _ in range(len(NEGATIVE) + 2)]
    unseen, place, kids = [False] * n, [0] * n, [0] * n
    for k in range(n):
        found = tokens(tags[k], page.attrs[k])
        for j, words in enumerate((*NEGATIVE.values(), EITHER, POSITIVE)):
            if not found.isdisjoint(words):
                flag[j].append(k)
        p = parent[k]
        unseen[k] = tags[k] in UNSEEN or "hidden" in found or (p >= 0 and unseen[p])
        if p >= 0:
            place[k] = kids[p]
            kids[p] += 1
    for j, nodes in enumerate(flag):
        x[nodes, j] = 1
    frame = [t in FRAME for t in tags]
    x[frame, : len(flag)] = 0
    total, linked, punct, prose, words, pieces = [0.0] * n, [0.0] * n, [0] * n, [0.0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = tags[k] == "a" or in_link[parent[k]]
    for node, text in page.flow:
        if text and not unseen[node] and not text.isspace():
            size, w, s = len(text), text.count(" ") + 1, len(SEP.findall(text))
            total[node] += size
            words[node] += w
            pieces[node] += 1
            punct[node] += s
            if in_link[node]:
                linked[node] += size
            elif w >= 6 or (s and w >= 3):
                prose[node] += size
    own = list(prose)
    best = [0.0] * n  # prose of the nodes whose container this is
    for k in range(n - 1, 0, -1):
        if own[k] and not frame[k]:
            at, weight = parent[k] if tags[k] not in BOXES and tags[k] != "article" else k, 1.0
            while at > 0 and tags[at] in INNER | TEXT_TAGS | HEADS:
                at = parent[at]
            for _ in range(2):
                if at < 0 or frame[at]:
                    break
                best[at] += own[k] * weight
                at, weight = parent[at], 0.4
    count, links, longest, paras, heads, controls = [1] * n, [int(t == "a") for t in tags], list(total), [int(t == "p") for t in tags], [int(t in HEADS) for t in tags], [int(t in CONTROLS) for t in tags]
    upto = np.cumsum(total)
    for k in range(n - 1, 0, -1):
        p = parent[k]
        total[p] += total[k]
        linked[p] += linked[k]
        punct[p] += punct[k]
        prose[p] += prose[k]
        words[p] += words[k]
        pieces[p] += pieces[k]
        count[p] += count[k]
        links[p] += links[k]
        paras[p] += paras[k]
        heads[p] += heads[k]
        controls[p] += controls[k]
        if longest[k] > longest[p]:
            longest[p] = longest[k]
    worth = [b * (1 - linked[k] / max(total[k], 1)) for k, b in enumerate(best)]
    top = max(range(n), key=worth.__getitem__)
    in_best, has_best = [False] * n, [False] * n
    if worth[top] > 0:
        at = top
        while at >= 0:
            has_best[at] = True
            at = parent[at]
    for k in range(1, n):
        in_best[k] = (k == top and worth[top] > 0) or in_best[parent[k]]
    bad = x[:, : len(NEGATIVE)].max(axis=1) > 0
    by_parent: dict[int, list[int]] = {}
    previous, following, same, in_positive, in_negative = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    positive = x[:, COL["positive"]]
    for k in range(1, n):
        p = parent[k]
        by_parent.setdefault(p, []).append(k)
        in_positive[k] = max(in_positive[p], positive[p])
        in_negative[k] = max(in_negative[p], float(bad[p]))
    for own_kids in by_parent.values():
        kinds: dict[str, int] = {}
        for k in own_kids:
            kinds[tags[k]] = kinds.get(tags[k], 0) + 1
        for a, k in enumerate(own_kids):
            same[k] = kinds[tags[k]] / len(own_kids)
            previous[k] = total[own_kids[a - 1]] if a else 0.0
            following[k] = total[own_kids[a + 1]] if a + 1 < len(own_kids) else 0.0
    tag = lambda names: np.fromiter((t in names for t in tags), np.float32, n)
    up = np.maximum(np.array(parent), 0)
    total, linked, punct, kids, count = (np.array(v, np.float64) for v in (total, linked, punct, kids, count))
    ratio, dots, whole = linked / np.maximum(total, 1), 100 * punct / np.maximum(total, 1), max(1.0, total[0])
    for name, value in (
        ("in_positive", in_positive), ("in_negative", in_negative), ("unseen", unseen), ("text_tag", tag(TEXT_TAGS)), ("head_tag", tag(HEADS)), ("list_tag", tag(LISTS)), ("box_tag", tag(BOXES)), ("inner_tag", tag(INNER)), ("link_tag", tag({"a"})),
        ("control_tag", tag(CONTROLS)), ("frame_tag", frame), ("depth", page.depth), ("siblings", kids[up]), ("place", np.array(place) / np.maximum(kids[up], 1)), ("size", np.log1p(total)), ("density", total / count), ("links", ratio),
        ("children", kids), ("subtree", np.log1p(count)), ("parent_links", ratio[up]), ("share", total / whole), ("parent_share", total / np.maximum(total[up], 1)), ("punctuation", dots), ("parent_punctuation", dots[up]), ("prose", np.log1p(prose)),
        ("longest", np.log1p(longest)), ("paragraphs", np.log1p(paras)), ("heads", np.log1p(heads)), ("controls", np.log1p(controls)), ("before", (upto - total) / whole), ("after", 1 - upto / whole), ("previous", np.log1p(previous)),
        ("next", np.log1p(following)), ("same", same), ("in_best", in_best), ("has_best", has_best), ("best_share", np.array(worth) / max(1.0, worth[top])), ("mean_words", np.array(words) / np.maximum(pieces, 1)), ("link_count", np.log1p(links)),
    ):
        x[:, COL[name]] = value
    return x


# ---- pages of known construction

MARK = "data-made"  # "1" or "0": the label of an element and, up to the next mark, of what is in it


def marked(page: Page) -> np.ndarray:
    """Labels by MARK; what holds content is content, and so is the frame."""
    n, y = len(page.tags), np.zeros(len(page.tags), np.int8)
    for k in range(1, n):
        own = page.attrs[k].get(MARK)
        y[k] = int(own) if own else y[page.parent[k]]
    held = y.copy()
    for k in range(n - 1, 0, -1):
        if held[k] and page.attrs[page.parent[k]].get(MARK) != "0":
            held[page.parent[k]] = 1
    return held


class Maker:
    """Made pages over some words."""

    def __init__(self, words: list[str], rng: random.Random):
        self.words, self.rng = words or ["word"], rng

    def say(self, low: int, high: int) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 25) -> str:
        text = self.say(low, high)
        return text[:1].upper() + text[1:].rstrip(".,;:!?") + self.rng.choice(".....!?")

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def plain(self) -> str:
        """A name that tells nothing."""
        return self.rng.choice("abcdefgxyz") + self.rng.choice(["", "1", "7", "-12", "_row", "-col", "x9", "2b"])

    def named(self, tag: str, name: str | None, inner: str, mark: int | None = None) -> str:
        attr = "" if not name else self.rng.choice([f' class="{name}"', f' id="{name}"', f" class='{name} {self.plain()}'"])
        return f"<{tag}{attr}{'' if mark is None else f' {MARK}={mark!s}'}>{inner}</{tag}>"

    def inline(self, text: str) -> str:
        kind = self.rng.random()
        if kind < 0.1:
            return f"<b>{text}</b>"
        words = text.split(" ")
        if kind < 0.3 and len(words) > 4:
            a = self.rng.randrange(len(words) - 2)
            inner = " ".join(words[a : a + 2])
            return " ".join([*words[:a], self.rng.choice([f"<em>{inner}</em>", f"<a href='/x'>{inner}</a>", f"<code>{inner}</code>", f"{inner}<br>"]), *words[a + 2 :]])
        return text

    def blocks(self) -> list[str]:
        """The blocks of an article."""
        rng, out = self.rng, []
        if rng.random() < 0.75:
            out.append(f"<{(h := rng.choice(['h1', 'h1', 'h2']))}>{self.say(2, 9)}</{h}>")
        for _ in range(rng.choice([1, 2, 2, 3, 4, 6, 9, 20])):
            kind = rng.random()
            if kind < 0.66:
                out.append(f"<p>{self.inline(self.prose(1, rng.choice([1, 2, 8])))}</p>")
            elif kind < 0.72:
                out += [f"<h{(k := rng.choice([2, 3]))}>{self.say(1, 6)}</h{k}>", f"<p>{self.prose()}</p>"]
            elif kind < 0.78:
                out.append(f"<{(u := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.inline(self.sentence(2, 18))}</li>" for _ in range(rng.randint(2, 6))) + f"</{u}>")
            elif kind < 0.82:
                out.append(f"<blockquote>{rng.choice(['{}', '<p>{}</p>']).format(self.prose())}</blockquote>")
            elif kind < 0.86:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.say(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 5))) + "</table>")
            elif kind < 0.89:
                out.append(f"<pre>{self.say(5, 30)}</pre>")
            elif kind < 0.95:
                name = rng.choice([None, self.plain(), f"{rng.choice(['text', 'par', 'p', 'sec'])}-{rng.choice(EITHER)}", rng.choice(EITHER)])
                out.append(self.named(rng.choice(["div", "section"]), name, rng.choice(["<p>{}</p>", "<p>{}</p>", "{}"]).format(self.prose(1, 3))))
            else:
                out.append(f"<figure><img src='x.png'><figcaption>{self.sentence(3, 9)}</figcaption></figure>")
        return out

    def links(self, low: int, high: int) -> str:
        rng, items = self.rng, [f'<a href="/{k}">{self.say(1, 3)}</a>' for k in range(self.rng.randint(low, high))]
        return rng.choice([lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(items), lambda: "".join(f"<div>{i}</div>" for i in items), lambda: "<p>" + " ".join(items) + "</p>"])()

    def junk(self) -> str:
        """A block of an unwanted kind. Some kinds can be told without names (links, controls, short lines), others seldom are."""
        rng = self.rng
        kind = rng.choice(["menu", "menu", "edge", "edge", "side", "notice", "advert", "form", "reader", "share"])
        if kind == "menu":
            inner = self.links(3, 9) if rng.random() < 0.8 else self.say(1, 4)
        elif kind == "edge":
            inner = rng.choice([f"&copy; {self.say(1, 3)} &middot; {self.say(1, 14)}.", f"&copy; 2024 {self.say(1, 4)}", self.say(1, 3), f"<a href='/'>{self.say(1, 2)}</a> {self.say(1, 4)}", f"<p>{self.say(1, 3)}</p>{self.links(2, 5)}"])
        elif kind == "side":
            inner = f"<h3>{self.say(1, 3)}</h3>" + rng.choice([self.links(3, 7), "".join(f"<div><a href='/{k}'>{self.say(3, 8)}</a><span>{self.say(1, 2)}</span></div>" for k in range(rng.randint(2, 6)))])
        elif kind == "notice":
            inner = f"{rng.choice(['<p>{}</p>', '{}', '<span>{}</span>']).format(self.prose(1, 2))}{rng.choice(['', '<button>{}</button>', '<a href=/p>{}</a>']).format(self.say(1, 2))}"
        elif kind == "advert":
            inner = rng.choice([self.sentence(3, 20), f"<a href='/ad'>{self.say(3, 12)}</a>", f"<p>{self.sentence()}</p><a href='/buy'>{self.say(1, 3)}</a>"])
        elif kind == "form":
            inner = f"<label>{self.say(1, 3)}</label><input name=q><button>{self.say(1, 1)}</button>" + rng.choice(["", f"<select><option>{self.say(1, 2)}</option></select>", f"<textarea>{self.say(1, 5)}</textarea>"])
        elif kind == "reader":
            each = rng.choice(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li>{} <p>{}</p></li>", "<div><span>{}</span><div>{}</div><a href='/r'>reply</a></div>"])
            inner = rng.choice(["", f"<h3>{self.say(1, 2)}</h3>"]) + "".join(each.format(self.say(1, 2), self.prose(1, 2)) for _ in range(rng.randint(1, 6)))
        else:
            inner = "".join(f"<a href='/s'>{self.say(1, 1)}</a>" for _ in range(rng.randint(2, 5)))
        tags = {"menu": ["nav", "menu"], "edge": ["header", "footer"], "side": ["aside"], "form": ["form", "fieldset"]}.get(kind, [])
        bare = {"menu": 0.5, "edge": 0.45, "side": 0.5, "form": 0.4, "share": 0.5, "reader": 0.2, "advert": 0.35, "notice": 0.25}[kind]
        if rng.random() < bare:
            return self.named(rng.choice(["div", "div", "section", "ul" if inner.startswith("<li") else "div", "p" if "<" not in inner else "div"]), rng.choice([None, self.plain(), self.plain(), rng.choice(EITHER)]), inner, 0)
        token = rng.choice(sorted(NEGATIVE[kind] - {"input", "button", "select", "textarea", "option"} - set(tags)))
        if tags and rng.random() < 0.5:
            return self.named(rng.choice(tags), rng.choice([None, self.plain(), token]), inner, 0)
        return self.named(rng.choice(["div", "div", "section", "ul" if inner.startswith("<li") else "div"]), rng.choice([token, f"{token}-{self.plain()}", f"{rng.choice(['page', 'main', 'x', 'top'])}-{token}", f"{token}_{rng.choice(EITHER)}"]), inner, 0)

    def page(self, inner: str | None = None) -> str:
        """A page around the given inner html of an article, or around made blocks."""
        rng = self.rng
        if rng.random() < 0.05:  # nothing but a text
            return rng.choice(["{}", "<html><body>{}</body></html>"]).format(self.named(rng.choice(["div", "p", "span", "td"]), rng.choice([None, self.plain()]), rng.choice([self.say(1, 30), self.prose()]), 1))
        blocks = re.split(r"(?=<p>)", inner) if inner else self.blocks()
        blocks = [f"<div {MARK}=1>{b}</div>" if rng.random() < 0.03 else b for b in blocks]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            blocks.insert(rng.randint(1, len(blocks)), self.junk())
        how = rng.random()
        if how < 0.15 and not inner:  # no container: the blocks stand among the rest
            core = "".join(re.sub(r"^<(\w+)", rf"<\1 {MARK}=1", b, count=1) if MARK not in b[:60] else b for b in blocks)
        else:
            tag, name = rng.choice([("article", None), ("article", self.plain()), ("main", None), ("div", rng.choice(["content", "main", "post-content", "entry", "story-text", "articlebody"])), ("section", "story"), ("div", self.plain()), ("div", self.plain()), ("div", self.plain()), ("div", None), ("section", None), ("td", None)])
            body = "".join(blocks)
            for _ in range(rng.choice([0, 0, 1, 2])):
                body = self.named("div", rng.choice([None, self.plain(), rng.choice(EITHER)]), body)
            core = self.named(tag, name, body, 1)
            core = f"<table><tr>{rng.choice(['', f'<td {MARK}=0>{self.links(3, 6)}</td>'])}{core}</tr></table>" if tag == "td" else core
        around = [self.junk() for _ in range(rng.choice([0, 1, 2, 3, 4, 6]))]
        cut = rng.randint(0, len(around))
        body = "".join(around[:cut]) + core + "".join(around[cut:])
        for _ in range(rng.choice([0, 0, 1, 2])):
            body = self.named("div", rng.choice([None, self.plain(), "page", "wrap"]), body)
        if rng.random() < 0.07:
            body = f"<form id='{self.plain()}'>{body}</form>"
        if rng.random() < 0.15:
            return body
        return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.say(2, 6)}</title><style>p{{margin:0}}</style><script>var t='{self.say(1, 5)}';</script></head><body>{body}</body></html>"


def training(source: str, seed: int) -> Iterator[tuple[Page, np.ndarray]]:
    """Pages with labels: the sampled page where it has an article element, and made ones over its words."""
    rng = random.Random(seed)
    m = re.search(r"<article[^>]*>(.*?)</article>", source, re.S)
    if m:
        page = Page(re.sub(r"<(nav|aside|header|footer|form|div class=\"ads?\")(?=[\s>])", rf"<\1 {MARK}=0", source[: m.start()] + source[m.start() : m.end()].replace("<article", f"<article {MARK}=1", 1) + source[m.end() :]))
        yield page, marked(page)
    words = re.findall(r"[^\s<>&\"']+", re.sub(r"<[^>]*>", " ", m.group(1) if m else source))[:400]
    for k in range(MADE):
        made = Maker(words, rng)
        page = Page(made.page(m.group(1) if m and k < 2 else None))
        yield page, marked(page)


SURE = 1e3


class Trees:
    """Boosted trees as arrays: for each tree, split features, thresholds and children; leaves hold predictions."""

    def __init__(self, model=None):
        self.weights, self.trees = list(model.treeWeights) if model else [], []
        for tree in model.trees if model else ():
            rows: list[list[float]] = []

            def add(node) -> int:
                at = len(rows)
                rows.append([-1, 0.0, at, at, float(node.prediction())])  # noqa: B023
                if node.getClass().getSimpleName() != "LeafNode":
                    rows[at][0], rows[at][1] = node.split().featureIndex(), node.split().threshold()  # noqa: B023
                    rows[at][2], rows[at][3] = add(node.leftChild()), add(node.rightChild())  # noqa: B023
                return at

            add(tree._java_obj.rootNode())
            self.trees.append(np.array(rows))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being content; without trees, by names alone."""
        total = np.zeros(len(x)) if self.trees else np.where(x[:, : len(NEGATIVE)].max(axis=1) > 0, -0.5, 0.5)
        for weight, t in zip(self.weights, self.trees, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = t[at, 0].astype(np.int64)
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1], t[at, 2], t[at, 3])
                at = np.where(f >= 0, go, at).astype(np.int64)
            total += weight * t[at, 4]
        return np.where(x[:, COL["frame_tag"]] > 0, SURE, np.where(x[:, COL["unseen"]] > 0, -SURE, 2 * total))


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept in the most likely labelling without a kept node below a dropped one."""
    n = len(parent)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    kept, dropped = yes.copy(), no.copy()
    for k in range(n - 1, 0, -1):  # children come after their parents
        kept[parent[k]] += max(kept[k], dropped[k])
        dropped[parent[k]] += dropped[k]
    keep = np.zeros(n, bool)
    keep[0] = True
    for k in range(1, n):
        keep[k] = keep[parent[k]] and kept[k] > dropped[k]
    return keep


def fitted(pages: DataFrame, most: int = TRAIN_PAGES) -> Trees:
    sample = pages.where("html is not null").orderBy(F.xxhash64("page_id", "html"), "page_id").limit(most).select("html")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                for page, y in training(t, zlib.crc32(t.encode("utf-8", "replace"))):
                    x = features(page)
                    used = (x[:, COL["frame_tag"]] == 0) & (x[:, COL["unseen"]] == 0)
                    if used.any():
                        yield pa.RecordBatch.from_arrays([pa.array(x[used].astype(np.float64).tolist(), pa.list_(pa.float64())), pa.array(y[used].astype(np.float64))], ["x", "label"])

    rows = written(sample.repartition(8).mapInArrow(nodes, "x array<double>, label double"), "nodes")
    if rows.select("label").distinct().count() < 2:
        return Trees()
    data = rows.select(array_to_vector("x").alias("features"), "label")
    return Trees(GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(data))


def main_text(source: str | None, trees: Trees) -> str:
    if not source:
        return ""
    page = Page(source)
    return page.text(decode(page.parent, trees(features(page))))


def extracted(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text, n_chars: a row per row of pages."""
    sent = Sent(pages.sparkSession, trees)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.get()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [Page(t or "") for t in part.column(2).to_pylist()]
                xs = [features(p) for p in found]
                odds = np.split(own(np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1])
                texts = [p.text(decode(p.parent, o)) for p, o in zip(found, odds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, fitted(pages))
