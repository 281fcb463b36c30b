"""Operator 2: main text of web pages by a linear-chain conditional random field.

A page is cut into its leaf blocks (runs of text between block-level tags).
Each block has features of its ancestors (tags, words of class, id and role)
and of its text (length, links, marks, place in the page). The field's two
labels, article and surroundings, are decoded by Viterbi over the page's
blocks. It is trained by gradient ascent on the exact likelihood over labelled
pages, which are laid out from a seeded grammar of page parts here, so nothing
is fitted to the pages that are extracted.

Character references are decoded, white space inside a block becomes one
space, blocks join in page order by two newlines; nothing is cut short.
Headings and captions inside the article belong to it. Null and empty pages
have the empty text; a tag that never closes is text, a comment that never
closes runs to the end of the page; repeated rows are treated alike; very long
pages are read whole, in time linear in their length, however they are broken;
an empty table gives an empty result, and only the three named columns are
read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe svg math object canvas head".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, and where the search for it stops.
_CLOSES = {"li": ("li", frozenset("ul ol menu".split())), "dt": ("dd dt", frozenset(["dl"])), "dd": ("dd dt", frozenset(["dl"])), "tr": ("tr", frozenset(["table"])), "td": ("td th", frozenset(["tr", "table"])), "th": ("td th", frozenset(["tr", "table"])), "option": ("option", frozenset(["select"]))}
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: Tags with quotes that lead to the end of the page; after so many, quotes count no more on that page.
QUOTES = 3
#: Deeper blocks are taken as lying at this depth.
DEPTH = 512
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Words of class, id and role, by what they tell.
_HINTS = {
    word: hint
    for hint, words in {
        "ad": "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion outbrain taboola",
        "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toolbar toc skip",
        "side": "sidebar side aside related recommended recommendations trending popular widget widgets rail complementary teaser more archive tags tagcloud",
        "foot": "footer foot copyright legal colophon contentinfo imprint credits",
        "head": "header masthead head logo brand topbar tagline hero banner",
        "notice": "cookie cookies consent notice notices gdpr privacy popup modal overlay alert toast dialog paywall disclaimer warning message",
        "form": "form login signin signup register search subscribe subscription newsletter contact poll survey",
        "share": "share sharing social follow like likes tweet facebook print tools byline author meta date",
        "comment": "comment comments commentlist reply replies respond response responses discussion disqus thread feedback review reviews reader readers",
        "content": "article post entry content story body text main page blog prose copy read",
    }.items()
    for word in words.split()
}


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    hints: frozenset[str]
    linked: int  # characters inside links


@lru_cache(maxsize=4096)
def _hints_of(attributes: str) -> frozenset[str]:
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for part in _PART.findall(m[1] or m[2] or m[3] or ""):
            hint = _HINTS.get(part.lower())
            if hint:
                found.add(hint)
    return frozenset(found)


def blocks_of(page: str) -> tuple[list[Block], str]:
    """The leaf blocks of a page in order, and its title."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []  # tags, each with its hints and those of all around it
    pending: list[str] = []
    linked = in_link = 0
    title, unquoted = "", 0
    none: frozenset[str] = frozenset()

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), stack[-1][1] if stack else none, linked))
            pending.clear()
        linked = 0

    def end_of_tag(at: int) -> int:
        """Where the > of a tag is whose name ends at `at`; -1 if there is none."""
        nonlocal unquoted
        end = page.find(">", at)
        if end >= 0 and unquoted < QUOTES and (page.find('"', at, end) >= 0 or page.find("'", at, end) >= 0):
            m = _ATTRIBUTES.match(page, at)
            if m:
                return m.end() - 1
            unquoted += 1
        return end

    def text(raw: str) -> None:
        nonlocal linked
        value = html.unescape(raw) if "&" in raw else raw
        pending.append(value)
        if in_link:
            linked += len(value)

    def pop_to(k: int) -> None:
        nonlocal in_link
        flush()
        del stack[k:]
        in_link = 0

    at, n, lower = 0, len(page), None
    while at < n:
        m = _OPEN.search(page, at)
        end = end_of_tag(m.end()) if m and m[2] else -1
        if m is None or m[2] and end < 0:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        if m[2] is None:
            end = page.find("-->", m.end()) if m[0] == "<!--" else page.find(">", m.end())
            at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        attributes, at = page[m.end() : end], end + 1
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in _BLOCK:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                else:
                    flush()
            continue
        if tag in _RAW and tag != "head":
            if attributes.rstrip().endswith("/"):
                continue
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            if len(lower) != n:  # lower-casing changed the length: search as it is
                found = re.compile(f"</{tag}", re.I).search(page, at)
                end = found.start() if found else -1
            if tag == "title" and not title:
                title = " ".join(html.unescape(page[at : end if end >= 0 else n]).split())
            if end < 0:
                at = n
            else:
                close = page.find(">", end)
                at = n if close < 0 else close + 1
            continue
        if tag == "br":
            pending.append(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            in_link += 1
        elif tag in _BLOCK:
            flush()
            if tag in _CLOSES:
                names, stop = _CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in names.split():
                        pop_to(k)
                        break
                    if stack[k][0] in stop:
                        break
            elif stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            if len(stack) < DEPTH:
                around = stack[-1][1] if stack else none
                stack.append((tag, around | _hints_of(attributes) if attributes else around))
    flush()
    return out, title


_KEPT_TAGS = frozenset("nav header footer aside article main form table ul ol li blockquote figure figcaption section p td th button select dialog pre h1 h2 h3 h4 h5 h6 dl fieldset label menu address details".split())
_SECTIONS = frozenset("article main nav aside header footer form section dialog".split())
_END = re.compile(r"[.!?…:;»”\"')\]]$")


def features_of(block: Block, k: int, n: int, title: str) -> list[str]:
    """Names of the features that hold for block k of n."""
    tags, text = block.tags, block.text
    size = len(text)
    out = ["bias", *{f"t:{t}" for t in tags if t in _KEPT_TAGS}, *(f"c:{h}" for h in block.hints)]
    leaf = tags[-1] if tags else "none"
    section = next((t for t in reversed(tags) if t in _SECTIONS), "none")
    out += [f"leaf:{leaf}", f"sec:{section}", f"sec:{section}|leaf:{leaf if leaf in ('p', 'div', 'li', 'a') or leaf in _HEADINGS else 'other'}"]
    if "article" in tags or "main" in tags or "content" in block.hints:
        out.append("inside")
        inner = block.hints - {"content"}
        if inner:
            out.append("inside|hint")
    elif not block.hints:
        out.append("outside|plain")
    out.append("len:" + str(0 if size < 20 else 1 if size < 60 else 2 if size < 150 else 3 if size < 400 else 4))
    share = block.linked / size
    out.append("link:" + ("0" if share == 0 else "1" if share < 0.3 else "2" if share < 0.7 else "3"))
    if _END.search(text):
        out.append("ends")
    if "©" in text or text[:9].lower() == "copyright":
        out.append("copyright")
    if title and (title.startswith(text) or text.startswith(title)):
        out.append("title")
    place = k / max(1, n - 1)
    out.append("place:" + ("0" if place < 0.1 else "2" if place > 0.9 else "1"))
    return out


@dataclass
class ChainField:
    """Weights: one for each feature (article against surroundings), and of the label pairs."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def decode(self, unary: list[float]) -> list[int]:
        """The best label sequence (Viterbi)."""
        if not unary:
            return []
        (p00, p01), (p10, p11) = self.pairs
        zero, one, back = 0.0, unary[0], []
        for u in unary[1:]:
            from_one0, from_one1 = one + p10 > zero + p00, one + p11 >= zero + p01
            back.append((from_one0, from_one1))
            zero, one = max(zero + p00, one + p10), max(zero + p01, one + p11) + u
        label = int(one >= zero)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]

    def labels(self, blocks: list[Block], title: str) -> list[int]:
        w = self.weights
        return self.decode([sum(w.get(f, 0.0) for f in features_of(b, k, len(blocks), title)) for k, b in enumerate(blocks)])


def train(pages: list[tuple[list[Block], str, list[int]]], rounds: int = 250, ridge: float = 2e-3) -> ChainField:
    """Maximises the mean log-likelihood of the label sequences, less a ridge, by Adam."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in features_of(b, k, len(blocks), title)] for k, b in enumerate(blocks)] for blocks, title, _ in pages]
    longest = max(len(r) for r in rows)
    x = np.zeros((len(rows), longest, len(names)))
    y, live = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest), bool)
    for i, page in enumerate(rows):
        for k, fs in enumerate(page):
            x[i, k, fs] = 1
        y[i, : len(page)] = pages[i][2]
        live[i, : len(page)] = True
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    flat_x = x.reshape(-1, len(names))
    moments = [np.zeros(len(names) + 4) for _ in range(2)]
    both = live[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    for step in range(1, rounds + 1):
        u = np.stack([np.zeros(y.shape), x @ w], axis=2)
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        alpha[:, 0] = u[:, 0]
        for k in range(1, longest):
            alpha[:, k] = np.where(live[:, k, None], np.logaddexp(alpha[:, k - 1, :1] + t[0], alpha[:, k - 1, 1:] + t[1]) + u[:, k], alpha[:, k - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for k in range(longest - 2, -1, -1):
            nxt = u[:, k + 1] + beta[:, k + 1]
            beta[:, k] = np.where(live[:, k + 1, None], np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:]), 0.0)
        p = np.exp(alpha + beta - z[:, None, None])[:, :, 1] * live
        pair = np.exp(alpha[:, :-1, :, None] + t + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        grad = np.concatenate([((y * live - p).ravel() @ flat_x) / len(rows), (seen - pair.sum(axis=(0, 1))).ravel() / len(rows)])
        grad -= ridge * np.concatenate([w, t.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, t = w + move[:-4], t + move[-4:].reshape(2, 2)
    return ChainField({f: float(w[i]) for f, i in names.items()}, ((float(t[0, 0]), float(t[0, 1])), (float(t[1, 0]), float(t[1, 1]))))


def labelled_pages(count: int = 320, seed: int = 11) -> list[tuple[list[Block], str, list[int]]]:
    """Pages laid out from parts that are known to be article or surroundings."""
    rnd = random.Random(seed)
    syllables = "ka lo mi ra te su no vi pe da ri mo na ze lu fo bi ca ne to".split()

    def word() -> str:
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rnd.randint(a, b)))

    def sentence(a: int = 4, b: int = 18) -> str:
        return words(a, b).capitalize() + rnd.choice("....!?")

    def prose(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(rnd.randint(a, b)))

    def attr(*names: str) -> str:
        return f' {rnd.choice(["class", "class", "id"])}="{rnd.choice(names)}"'

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    out = []
    for _ in range(count):
        title = sentence(3, 10)
        good: set[str] = set()

        def keep(text: str, good=good) -> str:
            good.add(" ".join(text.split()))
            return text

        def menu() -> str:
            items = "".join(f"<li>{link(words(1, 2))}</li>" for _ in range(rnd.randint(3, 9)))
            return rnd.choice([f"<nav><ul>{items}</ul></nav>", f"<div{attr('menu', 'navbar', 'main-nav', 'navigation')}><ul>{items}</ul></div>", f"<header><nav>{items}</nav></header>", f'<ul role="navigation">{items}</ul>'])

        def head() -> str:
            return rnd.choice([f"<header><div>{words(1, 3)}</div><p>{sentence()}</p></header>", f"<div{attr('header', 'masthead', 'site-header', 'topbar')}><h2>{words(1, 3)}</h2><p>{sentence()}</p></div>", f"<header><h1>{words(1, 3)}</h1></header>", ""])

        def ad() -> str:
            return rnd.choice([f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'ad-banner', 'promo')}>{prose(1, 3)}</div>", f"<div{attr('ad', 'advertisement', 'ad-slot')}><p>{prose(1, 2)}</p>{link(words(2, 4))}</div>", f"<aside{attr('ad', 'promo')}>{prose(1, 2)}</aside>"])

        def side() -> str:
            links = "".join(f"<li>{link(words(3, 8))}</li>" for _ in range(rnd.randint(2, 6)))
            return rnd.choice([f"<aside><h3>{words(1, 3)}</h3><ul>{links}</ul></aside>", f"<aside><p>{prose(1, 4)}</p></aside>", f"<div{attr('sidebar', 'related', 'widget', 'side-rail')}><h3>{words(1, 3)}</h3><p>{prose(1, 3)}</p><ul>{links}</ul></div>"])

        def notice() -> str:
            return rnd.choice([f"<div{attr('cookie-notice', 'consent', 'gdpr-banner', 'notice', 'cookie')}><p>{prose(1, 3)}</p><button>{words(1, 2)}</button></div>", f'<div role="dialog" class="modal"><p>{prose(1, 3)}</p></div>', f'<dialog><p>{prose(1, 2)}</p></dialog>', f'<div role="alert">{prose(1, 2)}</div>'])

        def form() -> str:
            return rnd.choice([f"<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>", f"<form{attr('newsletter', 'subscribe', 'search')}><p>{prose(1, 2)}</p><input></form>", f"<div{attr('newsletter', 'subscribe', 'login')}><h3>{words(2, 4)}</h3><p>{prose(1, 2)}</p></div>", f"<form><select><option>{word()}</option><option>{word()}</option></select></form>"])

        def comments() -> str:
            each = "".join(rnd.choice([f"<div{attr('comment', 'reply', 'comment-body')}><p>{prose(1, 4)}</p></div>", f"<li><b>{word()}</b><p>{prose(1, 4)}</p></li>", f"<article class=\"comment\"><p>{prose(1, 3)}</p></article>"]) for _ in range(rnd.randint(1, 5)))
            return f"<{(tag := rnd.choice(['section', 'div', 'ol']))}{attr('comments', 'comment-list', 'discussion', 'reader-comments', 'responses')}><h3>{words(1, 3)}</h3>{each}</{tag}>"

        def foot() -> str:
            return rnd.choice([f"<footer>&copy; {words(1, 3)} &middot; {sentence()}</footer>", f"<footer><p>{prose(1, 3)}</p>{link(word())}</footer>", f"<div{attr('footer', 'site-footer', 'copyright')}><p>{prose(1, 2)}</p><ul><li>{link(word())}</li></ul></div>"])

        def share() -> str:
            return f"<div{attr('share', 'social', 'share-tools')}>{link(word())} {link(word())}</div>"

        def paragraph() -> str:
            text = keep(prose(1, 6) if rnd.random() < 0.8 else sentence(1, 6))
            first, _, rest = text.partition(" ")
            return rnd.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b><br>", f"<p><em>{first}</em> {rest}</p>", f"<div>{text}</div>", f"<blockquote><p>{text}</p></blockquote>", f"<p>{first} {rest}</p>", f'<p><a href="/{word()}">{first}</a> {rest}</p>'])

        def body() -> str:
            parts = [f"<h1>{keep(title)}</h1>" if rnd.random() < 0.85 else f"<h2>{keep(title)}</h2>"]
            for _ in range(rnd.choice([1, 2, 3, 5, 8, 12])):
                r = rnd.random()
                if r < 0.1:
                    parts.append(f"<h2>{keep(words(2, 6))}</h2>")
                elif r < 0.17:
                    parts.append("<ul>" + "".join(f"<li>{keep(sentence(2, 12))}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>")
                elif r < 0.2:
                    parts.append(f"<figure><img><figcaption>{keep(sentence())}</figcaption></figure>")
                elif r < 0.22:
                    parts.append("<table><tr>" + "".join(f"<td>{keep(words(1, 3))}</td>" for _ in range(3)) + "</tr></table>")
                else:
                    parts.append(paragraph())
            for extra, chance in ((ad, 0.25), (share, 0.15), (notice, 0.08), (form, 0.12), (side, 0.1)):
                if rnd.random() < chance:
                    parts.insert(rnd.randint(1, len(parts)), extra())
            inside = "".join(parts) + (comments() if rnd.random() < 0.2 else "")
            content = attr("content", "post", "entry-content", "story", "article-body", "post-text", "main-content")
            return rnd.choice([f"<article>{inside}</article>", f"<article>{inside}</article>", f"<main>{inside}</main>", f"<main><article>{inside}</article></main>", f"<div{content}>{inside}</div>", f"<section{content}>{inside}</section>", f"<article><div{content}>{inside}</div></article>"])

        top = [f() for f, chance in ((notice, 0.3), (head, 0.5), (menu, 0.85), (ad, 0.5), (form, 0.15), (side, 0.2)) if rnd.random() < chance]
        rnd.shuffle(top)
        rest = [f() for f, chance in ((share, 0.2), (comments, 0.35), (side, 0.4), (ad, 0.3), (form, 0.25), (foot, 0.9), (notice, 0.2)) if rnd.random() < chance]
        middle = body()
        blocks, found_title = blocks_of(f"<html><head><title>{title}</title></head><body>{''.join(top)}{middle}{''.join(rest)}</body></html>")
        out.append((blocks, found_title, [int(b.text in good) for b in blocks]))
    return out


@lru_cache(maxsize=1)
def default_field() -> ChainField:
    return train(labelled_pages())


def main_text(page: str | None, model: ChainField) -> str:
    blocks, title = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, model.labels(blocks, title), strict=True) if keep)


def extracted(pages: DataFrame, model: ChainField | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    model = model or default_field()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.select("page_id", "url", F.col("html").alias("text")).schema

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), model) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(extract, kind)
