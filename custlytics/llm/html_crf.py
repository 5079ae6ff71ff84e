"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks, the text runs between block-level tags, in
page order.  Features of a block are its ancestors' tags, class and id words,
and properties of its text; a two-state chain (main text or not) is trained by
maximum conditional likelihood on labelled pages and decoded by Viterbi.  The
labelled pages come from a seeded generator of page layouts with known main
parts, so training needs no table and takes a second on the driver; the model
is a few hundred weights and is sent to the tasks.

Character references are decoded, white space inside a block becomes one
space, blocks are joined by one space; comments, scripts, styles and the head
are never text.  A head without end tag ends at the first tag (or, if no end
tag follows, text) that cannot stand in it.

Defined results: null and empty pages, and pages without a main block, give an
empty text; broken markup (unclosed tags, comments or scripts, stray end tags)
is read to its end: an unclosed script, style or textarea takes the rest of
the page, other unclosed elements are ordinary tags; repeated rows are extracted each; other columns are not
read."""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block (fixed values).
BLOCK_TAGS = frozenset("""address article aside blockquote body button center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe label legend li main menu nav ol optgroup option
p pre section select summary table tbody td tfoot th thead tr ul""".split())
#: Elements without content or end tag (fixed values).
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends an open element of the same kind, up to its container (fixed values).
ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
        "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Words that mark page furniture by their meaning (fixed values).
FURNITURE = frozenset("""copyright cookie cookies privacy subscribe newsletter comment comments reply share login sign
password search menu advertisement sponsored terms rights reserved follow email""".split())

#: Elements whose content is not text; without an end tag the first take the rest of the page (fixed values).
RAW_TAGS = frozenset("script style textarea".split())
DROPPED_TAGS = RAW_TAGS | frozenset("noscript template svg iframe object title".split())
#: Elements that can stand in a head (fixed values).
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
END_TAG = {t: re.compile(rf"</{t}\s*>", re.I) for t in (*DROPPED_TAGS, "head")}
#: Attributes of a start tag that closes itself: the slash is not part of an unquoted value.
SELF_CLOSED = re.compile(r"(?:[\s/]*+[^\s=/>\"']++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?+)*+\s*+/\s*+\Z")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>"
    r"|<[!?/][^>]*+>", re.S | re.I)
OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")
SENTENCE_END = re.compile(r"[.!?…][\"'»”)]?\s*$")


class _Open:
    """An open element.  Elements share their ancestors' features, so a page
    costs what its tags cost, however deep unclosed ones nest."""
    __slots__ = ("tag", "names", "above", "path", "found")

    def __init__(self, tag: str, attributes: str, above: _Open | None, path: int, known):
        self.tag, self.above, self.path = tag, above, path
        self.names = tuple(p for m in NAMED.finditer(attributes) for p in PART.findall((m[1] or m[2] or m[3] or "").lower())
                           ) if attributes else ()
        have = above.found if above else frozenset()
        fresh = {f for f in ("in:" + tag, *["name:" + n for n in self.names]) if f not in have and (known is None or f in known)}
        self.found: frozenset[str] = have | fresh if fresh else have


@dataclass
class Block:
    text: str
    node: _Open | None                                       # the innermost element it lies in
    link_chars: int

    def _around(self) -> list[_Open]:
        out, node = [], self.node
        while node:
            out.append(node)
            node = node.above
        return out[::-1]

    @property
    def tags(self) -> tuple[str, ...]:
        """Ancestors, outermost first."""
        return tuple(o.tag for o in self._around())

    @property
    def names(self) -> tuple[str, ...]:
        """Class, id and role words of the ancestors."""
        return tuple(n for o in self._around() for n in o.names)


def leaf_blocks(page: str | None, known=None) -> list[Block]:
    """The non-empty leaf blocks of a page, in order; with ``known``, features
    of their ancestors that it does not hold are not kept."""
    blocks: list[Block] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}                        # places in the stack of a tag's open elements
    walls: list[int] = []                                    # and of block elements
    paths: dict[tuple[int, str], int] = {}
    buffer: list[str] = []
    link_chars = links = 0

    def flush() -> None:
        nonlocal link_chars
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append(Block(text, stack[-1] if stack else None, link_chars))
            buffer.clear()
        link_chars = 0

    def text(raw: str) -> None:
        nonlocal link_chars
        if raw:
            raw = html.unescape(raw)
            buffer.append(raw)
            if links:
                link_chars += len(raw.strip())

    def push(tag: str, attributes: str) -> None:
        above = stack[-1] if stack else None
        path = paths.setdefault((above.path if above else -1, tag), len(paths))
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK_TAGS:
            walls.append(len(stack))
        stack.append(_Open(tag, attributes, above, path, known))

    def last(tag: str) -> int:
        """The place of the innermost open element of a tag, -1 for none."""
        return at[-1] if (at := places.get(tag)) else -1

    def pop_to(at: int) -> None:
        nonlocal links
        for o in reversed(stack[at:]):
            places[o.tag].pop()
            if o.tag in BLOCK_TAGS:
                walls.pop()
            links -= o.tag == "a"
        del stack[at:]

    at, page = 0, page or ""
    missing: set[str] = set()                                # no end tag of these follows
    in_head = in_title = False

    def end_of(tag: str) -> int | None:
        if tag not in missing:
            if end := END_TAG[tag].search(page, at):
                return end.end()
            missing.add(tag)
        return len(page) if tag in RAW_TAGS else None

    end_of_tags = page.rfind(">")                            # behind it only an open comment is a token

    def token():
        if at <= end_of_tags:
            return TOKEN.search(page, at)
        return OPEN_COMMENT.search(page, at)

    while m := token():
        raw, at = page[at:m.start()], m.end()
        if in_head and not in_title and raw.strip() and "head" in missing:
            in_head = False
        if not in_head:
            text(raw)
        tag = m[2] or m[5] if m.re is TOKEN else None
        if tag is None:                                      # comment, declaration
            continue
        tag = tag.lower()
        in_title = False
        if m[1] or m[4]:                                     # an end tag
            in_head = in_head and tag in HEAD_TAGS and tag not in ("head", "html")
            if tag in BLOCK_TAGS:
                flush()
            k = last(tag)
            if k >= 0 and (tag in BLOCK_TAGS or not walls or walls[-1] < k):   # else a stray end tag
                pop_to(k)
            continue
        if m[2] and tag in DROPPED_TAGS:
            end = at if tag == "svg" and SELF_CLOSED.match(m[3]) else end_of(tag)
            if end is not None:
                if tag in BLOCK_TAGS:
                    flush()
                in_head = in_head and tag in HEAD_TAGS
                at = end
                continue
        if tag == "head":
            in_head = True
            end_of(tag)
            continue
        in_head = in_head and tag in HEAD_TAGS
        if in_head:
            in_title = tag == "title"
            continue
        attributes = m[3] if m[3] is not None else m[6] or ""
        if tag in BLOCK_TAGS:
            flush()
            until = ENDS.get(tag)
            k = max(last("p"), last(tag) if until else -1)
            wall = max(map(last, until)) if until else walls[-1] if walls else -1
            if k >= 0 and k >= wall:
                pop_to(k)
        elif tag == "br":
            buffer.append(" ")
        if tag not in VOID_TAGS:
            push(tag, attributes)
            links += tag == "a"
    if not in_head or "head" in missing and not in_title:
        text(page[at:])
    flush()
    return blocks


def _bin(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


def block_features(blocks: list[Block]) -> Iterator[list[str]]:
    """Feature names of each block, from itself and its neighbours."""
    long = [len(b.text.split()) >= 20 for b in blocks]
    before: int | None = None                                # path of the block before
    nearest: dict[int, str] = {}                             # tag of the innermost block element, by path
    for k, b in enumerate(blocks):
        path = b.node.path if b.node else -1
        if path not in nearest:
            node = b.node
            while node and node.tag not in BLOCK_TAGS and node.path not in nearest:
                node = node.above
            tag = "none" if not node else node.tag if node.tag in BLOCK_TAGS else nearest[node.path]
            nearest[path], node = tag, b.node
            while node and node.tag not in BLOCK_TAGS and node.path not in nearest:
                nearest[node.path], node = tag, node.above
        words = b.text.split()
        found = {"bias", "tag:" + nearest[path]}
        found.update(b.node.found if b.node else ())
        found.add(f"words:{_bin(len(words), (3, 6, 10, 20, 40, 80))}")
        found.add(f"links:{_bin(b.link_chars / len(b.text), (0.01, 0.3, 0.6, 0.9))}")
        found.add(f"ends:{bool(SENTENCE_END.search(b.text))}")
        found.add(f"commas:{_bin(b.text.count(',') + b.text.count('.'), (1, 3, 6))}")
        found.add(f"mark:{b.text[:1] in '©|»›·'}")
        found.update("says:" + w for w in FURNITURE.intersection(PART.findall(b.text.lower())))
        found.add(f"place:{_bin(k / len(blocks), (0.1, 0.3, 0.7, 0.9))}")
        found.add(f"before:{long[k - 1] if k else 'start'}")
        found.add(f"after:{long[k + 1] if k + 1 < len(long) else 'end'}")
        found.add(f"same:{before == path}")
        before = path
        yield sorted(found)


# -- labelled pages ----------------------------------------------------------

class _Pages:
    """Generator of labelled pages: layouts of real sites over nonsense words,
    so that only structure and shape can be learned."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        parts = ["th", "on", "er", "re", "an", "le", "qu", "sch", "ción", "é", "ou", "in", "st", "ei", "la", "ti"]
        out = []
        for _ in range(r.randint(lo, hi)):
            out.append("".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "", ",", "."]))
        return " ".join(out)

    def sentence(self, lo: int = 8, hi: int = 70) -> str:
        return self.words(lo, hi).capitalize().rstrip(",.") + self.r.choice([".", ".", ".", "!", "?"])

    def furniture(self, kind: str) -> str:
        r, w, s = self.r, self.words, self.sentence
        links = "".join(f'<li><a href="/{k}">{w(1, 2)}</a></li>' for k in range(r.randint(3, 8)))
        return {
            "nav": r.choice([f"<nav><ul>{links}</ul></nav>", f'<div class="menu"><ul>{links}</ul></div>',
                             f'<div id="navigation" role="navigation">{links}</div>', f'<ul class="breadcrumb">{links}</ul>']),
            "header": r.choice([f"<header><a href='/'>{w(1, 3)}</a><p>{w(3, 7)}</p></header>",
                                f'<div id="header"><h2>{w(1, 3)}</h2><span>{w(2, 6)}</span></div>',
                                f'<header class="site-header"><h1>{w(1, 4)}</h1></header>']),
            "ad": r.choice([f'<div class="ad">{s(3, 25)}</div>', f'<div class="advert banner"><p>{s(4, 25)}</p></div>',
                            f'<aside class="sponsored"><a href="#">{s(4, 16)}</a></aside>', f'<div id="ads"><b>{w(2, 6)}</b> {s(4, 20)}</div>',
                            f'<div class="promo">{s(5, 30)}</div>']),
            "side": r.choice([f'<aside><h3>{w(1, 3)}</h3><ul>{links}</ul><p>{s(5, 30)}</p></aside>',
                              f'<div class="sidebar"><h4>{w(1, 3)}</h4><p>{s(5, 40)}</p>{links}</div>',
                              f'<div class="related"><h3>{w(1, 4)}</h3><ul>{links}</ul></div>']),
            "notice": r.choice([f'<div class="cookie-notice">{s(5, 30)} <button>{w(1, 2)}</button></div>',
                                f'<div id="consent" role="dialog"><p>We use cookies. {s(4, 25)}</p><button>{w(1, 2)}</button></div>',
                                f'<div class="notice">{s(4, 30)}</div>', f'<div class="alert message"><p>{s(4, 30)}</p></div>']),
            "form": r.choice([f'<form action="/s"><label>{w(1, 3)}</label><input name="q"><button>{w(1, 2)}</button></form>',
                              f'<form class="newsletter"><p>Subscribe: {s(4, 20)}</p><select><option>{w(1, 1)}</option><option>{w(1, 1)}</option></select></form>']),
            "share": f'<div class="share social"><a href="#">{w(1, 1)}</a> <a href="#">{w(1, 1)}</a></div>',
            "comments": r.choice([
                '<section id="comments"><h3>' + w(1, 3) + "</h3>" + "".join(
                    f'<div class="comment"><b>{w(1, 2)}</b><p>{s(4, 60)}</p></div>' for _ in range(r.randint(1, 5))) + "</section>",
                '<ol class="commentlist">' + "".join(f"<li><cite>{w(1, 2)}</cite><p>{s(4, 60)}</p></li>" for _ in range(r.randint(1, 5))) + "</ol>",
                '<div class="comments">' + "".join(
                    f'<article class="comment"><p>{s(4, 60)}</p></article>' for _ in range(r.randint(1, 4))) + "</div>",
                '<div class="replies responses">' + "".join(f'<div class="reply"><p>{s(4, 50)}</p></div>' for _ in range(r.randint(1, 4))) + "</div>"]),
            "footer": r.choice([f"<footer>&copy; {w(1, 2)} &middot; {s(4, 20)}</footer>", f'<div id="footer"><p>© 2024 {w(2, 8)}</p>{links}</div>',
                                f"<footer><ul>{links}</ul><p>{s(4, 20)}</p></footer>", f'<div class="footer">Copyright {w(3, 12)}</div>']),
        }[kind]

    def paragraph(self) -> str:
        r = self.r
        body = self.sentence(*r.choice([(1, 6), (8, 30), (20, 90), (60, 160)]))
        if r.random() < 0.12:                                # a stray word or two
            return self.words(1, 3)
        if r.random() < 0.15:
            body = f"<b>{body}" + r.choice(["</b>", "<br>"])
        elif r.random() < 0.15:
            body += f' <a href="#">{self.words(1, 3)}</a> {self.words(2, 10)}.'
        elif r.random() < 0.1:                               # junk and shouting is main text as well
            body = body.upper().replace(" ", "!! ")
        return body

    def main(self) -> list[str]:
        """The blocks of an article."""
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(1, 10)}</h1>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
            kind = r.random()
            if kind < 0.75:
                out.append(f"<p>{self.paragraph()}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif kind < 0.83:
                out.append(f"<h2>{self.words(1, 7)}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.sentence(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote>{self.sentence(4, 40)}</blockquote>")
            else:
                out.append(f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>")
        return out or [f"<p>{self.paragraph()}</p>"]

    def page(self) -> tuple[str, list[bool]]:
        """A page and whether each of its leaf blocks is main text."""
        r = self.r
        parts: list[tuple[str, bool]] = []
        for kind, often in (("header", 0.4), ("nav", 0.85), ("notice", 0.3), ("ad", 0.6), ("side", 0.2), ("form", 0.15)):
            if r.random() < often:
                parts.append((self.furniture(kind), False))
        r.shuffle(parts)
        opening, closing = r.choice([("<article>", "</article>")] * 4 + [
            ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"),
            ('<div id="story" class="post">', "</div>"), ('<section class="entry article">', "</section>"),
            ('<div class="article-body text">', "</div>"), ('<div role="main">', "</div>"), ("<div>", "</div>"), ("", "")])
        inner = [(b, True) for b in self.main()]
        for kind, often in (("ad", 0.12), ("share", 0.15), ("form", 0.05), ("side", 0.05), ("notice", 0.05)):
            if r.random() < often:
                inner.insert(r.randint(0, len(inner)), (self.furniture(kind), False))
        if r.random() < 0.1:
            inner.append((self.furniture("comments"), False))
        parts += [(opening, False), *inner, (closing, False)]
        for kind, often in (("share", 0.1), ("comments", 0.35), ("side", 0.3), ("form", 0.1), ("ad", 0.15), ("notice", 0.1), ("footer", 0.85)):
            if r.random() < often:
                parts.append((self.furniture(kind), False))
        # mark main parts with an attribute-free sentinel and read the labels back
        page = "<html><head><title>t</title></head><body>" + "".join(
            re.sub(r">([^<]+)", ">\x01\\1", p) if main else p for p, main in parts) + "</body></html>"
        labels = ["\x01" in b.text for b in leaf_blocks(page)]
        return page.replace("\x01", ""), labels


def labelled_pages(n: int = 500, seed: int = 3) -> list[tuple[str, list[bool]]]:
    source = _Pages(seed)
    pages = [source.page() for _ in range(n)]
    for _ in range(n // 25):                                 # bare text without markup
        pages.append((source.sentence(20, 90), [True]))
    return pages


# -- the chain ---------------------------------------------------------------

@dataclass
class Chain:
    """Weights: ``emit`` (feature x 2), ``move`` (2 x 2), ``first`` and ``last``."""
    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def scores(self, blocks: list[Block]) -> np.ndarray:
        names = self.names
        return np.array([self.emit[[names[f] for f in fs if f in names]].sum(axis=0) for fs in block_features(blocks)])

    def viterbi(self, scores: np.ndarray) -> list[bool]:
        """The best sequence of states."""
        if not len(scores):
            return []
        rows, move = scores.tolist(), self.move.tolist()
        a, b = rows[0][0] + self.first[0], rows[0][1] + self.first[1]
        back = []
        for e0, e1 in rows[1:]:
            to0 = (a + move[0][0], b + move[1][0])
            to1 = (a + move[0][1], b + move[1][1])
            back.append((to0[1] > to0[0], to1[1] > to1[0]))
            a, b = max(to0) + e0, max(to1) + e1
        state = b + self.last[1] > a + self.last[0]
        out = [bool(state)]
        for from0, from1 in reversed(back):
            state = from1 if state else from0
            out.append(bool(state))
        return out[::-1]


def train(pages: list[tuple[str, list[bool]]], rounds: int = 150, rate: float = 0.1, decay: float = 2e-3) -> Chain:
    """Maximum conditional likelihood with a quadratic penalty, by Adam over
    all pages at once (forward-backward on padded arrays)."""
    found = [(list(block_features(leaf_blocks(p))), y) for p, y in pages if y]
    counts: dict[str, int] = {}
    for feats, _ in found:
        for fs in feats:
            for f in fs:
                counts[f] = counts.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= 3))}
    n, steps = len(found), max(len(y) for _, y in found)
    x = np.zeros((n, steps, len(names)), np.float32)
    y = np.zeros((n, steps), np.int64)
    mask = np.zeros((n, steps), bool)
    for i, (feats, labels) in enumerate(found):
        mask[i, :len(labels)] = True
        y[i, :len(labels)] = labels
        for k, fs in enumerate(feats):
            x[i, k, [names[f] for f in fs if f in names]] = 1.0
    flat = x[mask]
    length, rows = mask.sum(axis=1), np.arange(n)
    theta = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    m, s = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    truth = np.eye(2)[y]
    pairs = np.einsum("nta,ntb->nab", truth[:, :-1] * mask[:, 1:, None], truth[:, 1:]).sum(axis=0)
    for r in range(1, rounds + 1):
        emit, move, first, last = theta
        e = np.zeros((n, steps, 2))
        e[mask] = flat @ emit
        e[rows, 0] += first
        e[rows, length - 1] += last
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = np.where(mask[:, t, None], np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]) + e[:, t],
                                   alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            ahead = e[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:]), 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        joint = np.exp(alpha[:, :-1, :, None] + move + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        off = p - truth * mask[:, :, None]
        grads = [flat.T @ off[mask] / n + decay * emit, (joint.sum(axis=(0, 1)) - pairs) / n + decay * move,
                 off[:, 0].sum(axis=0) / n, off[rows, length - 1].sum(axis=0) / n]
        for k, g in enumerate(grads):
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s[k] + 0.01 * g * g
            theta[k] = theta[k] - rate * (m[k] / (1 - 0.9 ** r)) / (np.sqrt(s[k] / (1 - 0.99 ** r)) + 1e-8)
    return Chain(names, *theta)


@functools.lru_cache(maxsize=2)
def default_chain(pages: int = 500, seed: int = 3) -> Chain:
    return train(labelled_pages(pages, seed))


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page, chain.names)
    if not blocks:
        return ""
    keep = chain.viterbi(chain.scores(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, chain: Chain | None = None, *, page_id: str = "page_id", url: str = "url",
            page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row: one pass, no shuffle."""
    model = pages.sparkSession.sparkContext.broadcast(chain or default_chain())
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p.as_py(), chain) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    return rows.mapInArrow(run, schema)
