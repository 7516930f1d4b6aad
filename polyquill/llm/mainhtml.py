"""Main text of web pages from flat text blocks and a decision tree over shallow features.

A page is cut into flat blocks at block-level tags; scripts, styles, comments and markup leave nothing.  Features of a block are
its word count and link density, those of the block before and after it, whether it is a heading or an item or ends like a sentence,
what enclosing tags (or, where pages mark them so, class names) say, and whether it lies outside the part that a page marks as
its content; further how many of its words are those of notices, and where on the page it is.  A name that has a role's word beside other words is a hint of its own.  The tree is grown (Gini) on a small labelled table that is made from fixed page templates of several layouts (marked
content, plain body, tables, menus, forms, asides and comments inside the article), with words drawn at random, so its size is fixed.

Defined results: null or empty html gives an empty text; repeated pages, and rows with a null page_id or url, are treated alike; character references are
decoded; white space inside a block becomes one space; an empty table gives no rows; markup that no parser takes is read as text without its tags,
so that no page can end a job; other columns of the table don't matter.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shipped

# Tags that begin and end a block, tags without text, and tags and names that speak of a block's role.
BLOCK = "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
SILENT = "script style noscript template svg canvas iframe object audio video head textarea".split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
ROLE_TAGS = {"content": "article main", "chrome": "nav header footer aside", "notice": "dialog", "form": "form select button option label fieldset"}
ROLE_WORDS = {
    "content": "article post entry content story main bodytext articlebody",
    "chrome": "nav navbar navigation menu header footer sidebar breadcrumb breadcrumbs masthead related share sharing social tags pagination pager copyright toc",
    "notice": "cookie cookies consent notice banner alert popup modal newsletter subscribe promo ad ads advert advertisement adsbygoogle sponsor sponsored gdpr",
    "comments": "comment comments reply replies disqus responses discussion",
}
# Words in a name that say where or how, not what; and words of notices.
NEUTRAL = set("bar box list lists link links item items wrapper wrap container block section area widget widgets panel inner outer left right top bottom site page posts buttons button global primary secondary overlay message messages thread respond icons icon group row col column body".split())
NOTICE_WORDS = set("cookie cookies consent subscribe newsletter advertisement advertising sponsored privacy policy copyright rights reserved terms login register abonnieren anzeige werbung datenschutz publicité confidentialité abonnez suscríbete publicidad privacidad".split())
ROLES = [*ROLE_TAGS, "comments", "hint"]
_TAG_ROLE = {t: k for k, v in ROLE_TAGS.items() for t in v.split()}
_WORD_ROLE = {w: k for k, v in ROLE_WORDS.items() for w in v.split()}
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
_SPACES = re.compile(r"\s+")


_STAYS = {"br", "option", "label", "legend", "caption", "summary", "html", "head", "body"}  # don't end an open paragraph
_IN_HEAD = {"title", "style", "script", "noscript", "template", "head", "html", "meta", "link", "base"}
_TAGS = re.compile(r"<[^>]*>")


_KNOWN: dict[tuple[str, str], frozenset] = {}  # tags and names met before; emptied when it has 10000


def _role_of_part(part: str) -> str | None:
    """The role that a part of a name speaks of: a role's word, or one with a neutral word after it."""
    if part in _WORD_ROLE:
        return _WORD_ROLE[part]
    return next((_WORD_ROLE[part[:n]] for n in range(len(part) - 1, 2, -1) if part[:n] in _WORD_ROLE and part[n:] in NEUTRAL), None)


def _roles_of_name(name: str) -> set[str]:
    """Roles of one class name.  A name all of whose parts are of roles, neutral or numbers says what the block is; where other words stand beside them (social-history,
    promo-code) it is a hint only, which words, links and neighbours can outvote."""
    parts = [p.lower() for p in _PARTS.split(name) if p]
    roles = [_role_of_part(p) for p in parts]
    found = {r for r in roles if r}
    rest = any(r is None and p not in NEUTRAL and not p.isdigit() for r, p in zip(roles, parts))
    others = found - {"content"}
    return {"hint"} if rest and others else others or found


def roles_of(tag: str, names: str) -> frozenset:
    if (tag, names) not in _KNOWN:
        if len(_KNOWN) >= 10_000:
            _KNOWN.clear()
        found = set().union(*(_roles_of_name(n) for n in names.split()))
        if tag in _TAG_ROLE:
            found.add(_TAG_ROLE[tag])
        if tag == "body":
            found.discard("content")
        _KNOWN[tag, names] = frozenset(found)
    return _KNOWN[tag, names]


class Blocks(HTMLParser):
    """Collects (text, words, linked words, roles, tag) of each block with text.  Open tags and roles are counted, so the work doesn't grow with the depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, int, frozenset, str]] = []
        self.open: list[tuple[str, frozenset]] = []
        self.tags: Counter[str] = Counter()
        self.roles: Counter[str] = Counter()
        self.blocks: list[str] = []
        self.silent = self.links = 0
        self.parts: list[tuple[str, bool]] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def flush(self) -> None:
        text = _SPACES.sub(" ", "".join(t for t, _ in self.parts)).strip()
        if text:
            linked = sum(len(t.split()) for t, in_link in self.parts if in_link)
            self.out.append((text, len(text.split()), linked, frozenset(r for r, n in self.roles.items() if n > 0), self.blocks[-1] if self.blocks else "body"))
        self.parts = []

    def push(self, tag: str, roles: frozenset) -> None:
        self.open.append((tag, roles))
        self.tags[tag] += 1
        self.roles.update(roles)
        if tag in BLOCK:
            self.blocks.append(tag)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def pop(self) -> str:
        tag, roles = self.open.pop()
        self.tags[tag] -= 1
        self.roles.subtract(roles)
        if tag in BLOCK:
            self.blocks.pop()
        self.silent -= tag in SILENT
        self.links -= tag == "a"
        return tag

    def close_to(self, tag: str) -> None:
        while self.open and self.pop() != tag:
            pass

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.tags["head"] > 0 and tag in BLOCK and tag not in _IN_HEAD:  # the head's end may be left out
            self.close_to("head")
        if tag in BLOCK:
            self.flush()
            if self.tags["p"] > 0 and tag not in _STAYS:  # so may a paragraph's
                self.close_to("p")
        if tag in VOID:
            return
        given = dict(attrs)
        names = f"{given.get('class') or ''} {given.get('id') or ''} {given.get('role') or ''}"
        roles = set(roles_of(tag, names))
        if tag == "header" and self.roles["content"] > 0:  # an article's own head
            roles.discard("chrome")
        if roles - {"content", "hint"}:
            roles.discard("content")
        if "hidden" in given or "display:none" in (given.get("style") or "").replace(" ", ""):
            roles.add("notice")
        self.push(tag, frozenset(roles))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.tags[tag] <= 0:
            return
        if tag not in BLOCK and tag not in SILENT:  # inline: only within the block around it
            for t, _ in reversed(self.open):
                if t == tag:
                    break
                if t in BLOCK:
                    return
        self.close_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append((data, self.links > 0))


def blocks(html: str | None) -> list[tuple[str, int, int, frozenset, str]]:
    parser = Blocks()
    try:
        parser.feed(html or "")
        parser.close()
    except Exception:  # what the parser can't take is read as text without its tags
        parser.handle_data(_TAGS.sub(" ", parser.rawdata))
    parser.flush()
    return parser.out


FEATURES = ["words", "links", "before_words", "before_links", "after_words", "after_links", "heading", "item", "stop", "notice_words", "place", *ROLES, "outside"]
_FIRST_ROLE = FEATURES.index(ROLES[0])


def features(found: list[tuple[str, int, int, frozenset, str]]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    for i, (text, words, linked, roles, tag) in enumerate(found):
        x[i, 0], x[i, 1] = words, linked / words
        x[i, 6:9] = tag[0] == "h" and tag[1:].isdigit(), tag in ("li", "td", "th", "dd", "dt"), text[-1] in ".!?:;\"'”»)"
        x[i, 9] = sum(w.strip(".,;:!?()").lower() in NOTICE_WORDS for w in text.split()) / words
        x[i, _FIRST_ROLE:-1] = [r in roles for r in ROLES]
    x[:, 10] = np.arange(len(found)) / max(len(found) - 1, 1)
    x[1:, 2:4] = x[:-1, 0:2]
    x[:-1, 4:6] = x[1:, 0:2]
    content = x[:, FEATURES.index("content")]
    x[:, -1] = (content == 0) & content.any()
    return x


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, set[str]]]:
    """(html, its good blocks) from templates."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    text = lambda a, b: words(a, b) + "."
    link = lambda: f"<a href='/x'>{word()}{r.choice(['', '', '.', ','])}</a>"
    links = lambda k: "".join(f"<li>{link()}</li>" for _ in range(k))
    weak = lambda: r.choice([f"{r.choice(['social', 'promo', 'related', 'header', 'alert', 'share', 'notice', 'banner', 'comment', 'tags', 'menu'])}{r.choice('-_')}{word()}{word()}", "legal"])  # noqa: E731  # a name that is a hint only

    def notice() -> str:  # a short text of which some words are of notices
        some = [word() for _ in range(r.randint(1, 10))]
        for _ in range(r.randint(1, 3)):
            some.insert(r.randint(0, len(some)), r.choice(sorted(NOTICE_WORDS)))
        return " ".join(some).capitalize() + r.choice(["", ".", "."])

    unmarked = [lambda: f"<div>{notice()}</div>", lambda: f"<p>{notice()}</p>", lambda: f"<div><p>{notice()}</p> {link()}</div>"]
    noise = [
        lambda: f"<div class={weak()}>{link()} {link()}</div>", lambda: f"<section class={weak()}><ul>{links(3)}</ul></section>",
        lambda: f"<nav><ul>{links(5)}</ul></nav>", lambda: f"<div class=menu>{link()} {link()}</div>", lambda: f"<div class=ad>{text(3, 40)}</div>", lambda: f"<aside><h3>{words(1, 4)}</h3><p>{text(3, 60)}</p></aside>",
        lambda: f"<div class=cookie-banner><p>{text(4, 60)}</p></div>", lambda: f"<form><label>{words(1, 3)}</label><p>{text(2, 40)}</p><button>{word()}</button></form>", lambda: f"<div class=sidebar><p>{text(3, 60)}</p>{link()}</div>",
        lambda: f"<div class=comments><h3>{words(1, 3)}</h3><p>{text(3, 90)}</p><p>{text(3, 90)}</p></div>", lambda: f"<section id=comments><div class=comment>{text(3, 90)}</div></section>", lambda: f"<div class=related>{link()} {link()}</div>",
        lambda: f"<div class=share>{link()}</div>", lambda: f"<ul>{links(4)}</ul>", lambda: f"<div>{link()} {link()} {link()}</div>",
        lambda: "".join(f"<div>{word()} {' '.join(link() for _ in range(r.randint(2, 8)))}</div>" for _ in range(r.randint(3, 6))), lambda: "".join(f"<p>{link()} {word()} {' '.join(link() for _ in range(r.randint(2, 8)))}</p>" for _ in range(r.randint(3, 6))),  # rows of links that no name marks
    ]
    out = []
    for _ in range(n):
        good: set[str] = set()

        def keep(t: str) -> str:
            good.add(t)
            return t

        def linked() -> str:  # a sentence of which a part, or nearly all, is a link
            a, b, stop = words(1, 12), word(), r.choice(["", "."])
            if r.random() < 0.5:
                return f"<p>{a} <a href='/y'>{b}</a>{stop}</p>" if keep(f"{a} {b}{stop}") else ""
            return f"<p>{b} <a href='/y'>{a}</a>{stop}</p>" if keep(f"{b} {a}{stop}") else ""

        def para() -> str:
            kind = r.random()
            if kind < 0.25:
                return linked()
            if kind < 0.35:
                return f"<p class='{weak()}'>{keep(text(2, 90))}</p>"
            if kind < 0.45:
                return f"<div class='{weak()}'><p>{keep(text(6, 90))}</p><p>{keep(text(2, 60))}</p></div>"
            if kind < 0.5:
                return f"<p>{keep(words(12, 40) + ' ' + r.choice(sorted(NOTICE_WORDS)) + ' ' + text(8, 40))}</p>"
            return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}<br>", "<div>{}</div>", "<p><b>{}</p>", "<blockquote>{}</blockquote>"]).format(keep(text(2, 90)))

        def more() -> str:
            kind = r.random()
            if kind < 0.3:
                return f"<ul>{''.join(f'<li>{keep(text(2, 20))}</li>' for _ in range(3))}</ul>"
            if kind < 0.5:
                return f"<table><tr><th>{keep(words(1, 3))}</th><td>{keep(words(1, 4))}</td></tr></table>"
            return f"<h2>{keep(words(1, 6))}</h2>{para()}" if kind < 0.8 else para()

        layout = r.choice(["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div id=post>{}</div>", "<div>{}</div>", "{}", "{}"])
        title = f"<h1>{keep(words(2, 10))}</h1>"
        marked = layout[:5] in ("<arti", "<main") or "class=" in layout or "id=" in layout
        parts = [title if r.random() < 0.8 else f"<div class='{weak()} {weak()}'>{title}</div>", para(), para(), *(more() for _ in range(r.randint(0, 5)))]
        if layout != "{}":
            for _ in range(r.randint(0, 3)):  # noise inside the article
                parts.insert(r.randint(1, len(parts)), r.choice(noise)())
        if marked and r.random() < 0.5:  # an article's own words of this kind are its text
            parts.insert(r.choice([len(parts), r.randint(1, len(parts))]), f"<p>{keep(notice())}</p>")
        before, after = ([r.choice(noise)() for _ in range(r.randint(0, 3))] for _ in "ab")
        for side in (before, after):
            if r.random() < 0.4:
                side.insert(r.randint(0, len(side)), r.choice(unmarked)())
        if marked and layout[:2] != "<d" and r.random() < 0.5:  # marked content: what lies outside isn't
            before.append(f"<p>{text(3, 40)}</p>")
        head = f"<header><div>{words(1, 9)}</div></header>" if r.random() < 0.5 else ""
        foot = f"<footer>&copy; {word()} {words(2, 9)}</footer>" if r.random() < 0.6 else ""
        out.append((f"<html><body>{head}{''.join(before)}{layout.format(''.join(parts))}{''.join(after)}{foot}</body></html>", good))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 4):
    """A decision tree by Gini impurity: a share of good, or (feature, cut, low, high)."""
    share = float(y.mean()) if len(y) else 0.0
    if not depth or share in (0.0, 1.0):
        return share
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, j] <= cut
            a, b = y[low], y[~low]
            if len(a) < least or len(b) < least:
                continue
            g = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or g < best[0] - 1e-12:
                best = (g, j, float(cut), low)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-9:
        return share
    _, j, cut, low = best
    return (j, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def train():
    xs, ys = [], []
    for html, good in labelled_pages():
        found = blocks(html)
        xs.append(features(found))
        ys.append(np.array([b[0] in good for b in found], float))
    return grow(np.concatenate(xs), np.concatenate(ys))


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    low = x[:, tree[0]] <= tree[1]
    return np.where(low, classify(tree[2], x), classify(tree[3], x)) if len(x) else np.zeros(0, bool)


def extract_all(pages: list[str | None], tree) -> list[str]:
    """The texts of pages, whose blocks are classified together."""
    found = [blocks(h) for h in pages]
    x = [features(f) for f in found if f]
    good = iter(classify(tree, np.concatenate(x)).tolist() if x else [])
    return ["\n\n".join([b[0] for b in f if next(good)]) for f in found]


def extract(html: str | None, tree) -> str:
    return extract_all([html], tree)[0]


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = shipped(pages.sparkSession, train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = model()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = extract_all(part.column("html").to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
