"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its text blocks: runs of text that no block element interrupts, each with the
path of its open elements. A block is described by its ancestors (tags, words of class, id and role, and the
innermost telling one of them) and its text (length, links, ends, signs). The field scores main text against
the rest from these features and from the label of the block before; Viterbi finds the best labels of a page.
It is trained in NumPy on labelled pages of many layouts (``labelled_pages``, drawn from a fixed seed). Scripts,
styles, markup comments, titles, frames, templates and form controls are no blocks in the first place; text of formulas,
drawings, objects and of pages without scripts is judged like any other.

Character references are decoded, white space inside a block (no-break spaces included) becomes one space, and
the main blocks are joined by one space in page order. Pages are read whole and never move between tasks.

Defined cases: null, empty and text-free html give an empty text. Unclosed, crossed and cut-off tags are read as
far as they go; a script or style that nothing closes takes the rest of the page, other elements end with their parent.
Attributes are read as HTML reads them, quotes inside unquoted values included. Time is linear in the page, however
deep its elements are nested. Equal rows give equal results. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An attribute as HTML reads it: quotes enclose a value only directly after the equals sign.
ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+"""
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|" + re.sub(r"\((?!\?)", "(?:", ATTRIBUTE)
                   + r")*+)(?:>|\Z)", re.DOTALL)
MARK = re.compile(ATTRIBUTE)
RAW = frozenset("script style title textarea iframe noembed noframes".split())  # read up to their closing tag, and dropped
DARK = frozenset("template select datalist".split())  # elements whose text is never shown as text
BLOCKS = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead
tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes these open elements, up to the nearest one of the second set.
CLOSES = {**{t: (frozenset(["p"]), frozenset(["button", "td", "th", "table"])) for t in BLOCKS - {"br", "html", "body", "head", "option"}},
          "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
          "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
          "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
          "body": (frozenset(["head"]), frozenset())}
TAGS = """article aside main nav header footer section form body p div li ul ol td table th h1 h2 h3 h4 blockquote pre figure figcaption
button label fieldset dd dt dl a span details dialog menu address""".split()
WORDS = """ad ads advert advertisement sponsor sponsored promo banner sidebar side widget menu nav navigation breadcrumb breadcrumbs header masthead footer
foot comment comments reply respond discussion disqus commentlist cookie consent notice alert warning popup modal newsletter subscribe signup login search
share social related recommended more tags meta content post entry article story text main body copyright legal hidden contentinfo complementary
dialog author bio""".split()
NOTED = frozenset("article aside main nav header footer form dialog menu button".split())
VOCABULARY = frozenset(WORDS)
TEXTS = ["len0", "len1", "len2", "len3", "len4", "len5", "links", "somelinks", "stop", "mark", "copy", "digits", "start", "end", "bias"]
FEATURES = {f: i for i, f in enumerate([*(f"has:{t}" for t in TAGS), *(f"in:{t}" for t in TAGS), *(f"word:{w}" for w in WORDS),
                                        *(f"near:{n}" for n in sorted(set(WORDS) | NOTED)), *(f"text:{t}" for t in TEXTS)])}


def _words(attributes: str) -> frozenset[str]:
    """Telling words in class, id and role; ``hidden`` for what is not shown."""
    found, seen = set(), set()
    for name, a, b, c in MARK.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in seen:  # of repeated attributes the first counts
            continue
        seen.add(name)
        if name in ("class", "id", "role", "aria-label"):
            found.update(w for w in re.findall("[a-z]+", value) if w in VOCABULARY)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            found.add("hidden")
    return frozenset(found)


_words = lru_cache(maxsize=4096)(_words)


def _mask(names) -> int:
    return sum(1 << FEATURES[n] for n in set(names) if n in FEATURES)


_mask_of_words = lru_cache(maxsize=4096)(lambda words: _mask(f"word:{w}" for w in words))
_mask_of_near = lru_cache(maxsize=4096)(lambda near: _mask(f"near:{n}" for n in near))
_mask_of_has = lru_cache(maxsize=4096)(lambda tag: _mask([f"has:{tag}"]))
_mask_of_inner = lru_cache(maxsize=4096)(lambda tag: _mask([f"in:{tag}"]))


class Place:
    """An open element; what its path tells is added up from its parent's, so that depth costs nothing."""

    __slots__ = ("tag", "above", "near", "inner")

    def __init__(self, parent: Place | None, tag: str, words: frozenset[str]):
        self.tag = tag
        self.above = (parent.above if parent else 0) | _mask_of_has(tag) | _mask_of_words(words)
        near = words | {tag} if tag in NOTED else words
        self.near = _mask_of_near(near) if near else parent.near if parent else 0
        self.inner = _mask_of_inner(tag) if tag in BLOCKS else parent.inner if parent else 0


class _Open:
    """The stack of open elements, with the places of every tag and of blocks."""

    def __init__(self):
        self.stack, self.places, self.blocks, self.links, self.dark = [], {}, [], 0, 0

    def top(self) -> Place | None:
        return self.stack[-1] if self.stack else None

    def last(self, tag: str) -> int:
        """Where the innermost open ``tag`` is; -1 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def push(self, tag: str, words: frozenset[str]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(Place(self.top(), tag, words))
        self.links += tag == "a"
        self.dark += tag in DARK

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.links -= tag == "a"
            self.dark -= tag in DARK

    def close(self, tag: str) -> None:
        depth = self.last(tag)
        # an inline element does not close the blocks opened inside it
        if depth >= 0 and (tag in BLOCKS or tag in DARK or not self.blocks or self.blocks[-1] < depth):
            self.cut(depth)

    def make_room(self, tag: str) -> None:
        closed, limit = CLOSES.get(tag, ((), ()))
        if closed:
            floor = max(map(self.last, limit), default=-1)
            while (depth := max(map(self.last, closed))) > floor:
                self.cut(depth)


def blocks_of(page: str) -> list[tuple[str, Place | None, int]]:
    """``(text, innermost open element, characters in links)`` of every block, in time linear in the page."""
    out, parts, linked, at, size = [], [], 0, 0, len(page)
    there, endless = _Open(), set()

    def end(place):
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((text, place, linked))
        parts.clear()
        linked = 0
    while at < size:
        m = TOKEN.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text and not there.dark:
            parts.append(text)
            linked += len(text) if there.links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        place, dark = there.top(), there.dark
        if m[1]:
            there.close(tag)
            if tag in BLOCKS and not (dark and there.dark):
                end(place)
            continue
        if tag in RAW:
            parts.append(" ")
            if m[3].rstrip().endswith("/") or tag in endless:
                continue
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style"):
                at = size
            else:  # an open tag that nothing closes takes no text away
                endless.add(tag)
            continue
        there.make_room(tag)
        if tag in BLOCKS and not (dark and there.dark):  # inside dark elements nothing parts the text around them
            end(place)
        if tag not in VOID:
            there.push(tag, _words(m[3]))
        elif tag == "img":
            parts.append(" ")
    end(there.top())
    return out


@lru_cache(maxsize=65536)
def _features_in(mask: int) -> list[int]:
    return [f for f in range(len(FEATURES)) if mask >> f & 1]


def _path_features(place: Place | None) -> list[int]:
    return _features_in(place.above | place.near | place.inner) if place else []


def _text_features(text: str, linked: int, place: int, many: int) -> list[int]:
    n = len(text)
    found = ["bias", f"len{min(5, n.bit_length() // 2 - 1 if n > 3 else 0)}"]
    if 2 * linked >= n:
        found.append("links")
    elif linked:
        found.append("somelinks")
    if text[-1] in ".!?…":
        found.append("stop")
    if "!" in text or "%" in text:
        found.append("mark")
    if "©" in text or "All rights" in text:
        found.append("copy")
    if text[0].isdigit() or text[-1].isdigit():
        found.append("digits")
    if place == 0:
        found.append("start")
    if place == many - 1:
        found.append("end")
    return [FEATURES[f"text:{f}"] for f in found]


def features_of(blocks) -> list[list[int]]:
    return [_path_features(place) + _text_features(text, linked, i, len(blocks)) for i, (text, place, linked) in enumerate(blocks)]


class Field:
    """``weights[f, y]`` of feature f with label y, ``moves[x, y]`` of label y after x; label 1 is main text."""

    def __init__(self):
        self.weights, self.moves = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], steps: int, ridge: float = 1e-3, rate: float = 0.1) -> None:
        """Maximises the conditional likelihood of the labels (Adam on all pages at once)."""
        n, t = len(pages), max(len(y) for _, y in pages)
        x, y, there = np.zeros((n, t, len(FEATURES)), np.float32), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
        for i, (rows, labels) in enumerate(pages):
            for j, row in enumerate(rows):
                x[i, j, row] = 1
            y[i, :len(labels)], there[i, :len(labels)] = labels, True
        params = [self.weights, self.moves]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rows, places = np.arange(n)[:, None], np.arange(t)
        for step in range(1, steps + 1):
            e = x.reshape(n * t, -1) @ self.weights.astype(np.float32)
            e = e.reshape(n, t, 2).astype(float)
            fore, back = np.zeros_like(e), np.zeros_like(e)
            fore[:, 0] = e[:, 0]
            for i in range(1, t):  # beyond the end of a page everything stays as it is
                come = e[:, i] + np.logaddexp(fore[:, i - 1, :1] + self.moves[0], fore[:, i - 1, 1:] + self.moves[1])
                fore[:, i] = np.where(there[:, i, None], come, fore[:, i - 1])
            for i in range(t - 2, -1, -1):
                ahead = e[:, i + 1] + back[:, i + 1]
                go = np.logaddexp(self.moves[:, 0] + ahead[:, :1], self.moves[:, 1] + ahead[:, 1:])
                back[:, i] = np.where(there[:, i + 1, None], go, back[:, i + 1])
            z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])[:, None, None]
            de = np.exp(fore + back - z) * there[:, :, None]
            pairs = np.exp(fore[:, :-1, :, None] + self.moves + (e + back)[:, 1:, None, :] - z[..., None]) * there[:, 1:, None, None]
            pairs = pairs.sum((0, 1))
            np.subtract.at(pairs, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
            de[rows, places, y] -= there
            grads = [(x.reshape(n * t, -1).T @ de.reshape(n * t, 2).astype(np.float32)) / n + ridge * self.weights, pairs / n + ridge * self.moves]
            for k, (p, g) in enumerate(zip(params, grads)):
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g ** 2
                p -= rate * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Best labels of a page (Viterbi)."""
        lean = (self.weights[:, 1] - self.weights[:, 0])  # only differences matter
        (a00, a01), (a10, a11) = self.moves.tolist()
        best0, best1, came = 0.0, 0.0, []
        for i, row in enumerate(rows):
            e = float(lean[row].sum())
            if i:
                from0, from1 = best0 + a00 >= best1 + a10, best0 + a01 >= best1 + a11
                best0, best1 = max(best0 + a00, best1 + a10), max(best0 + a01, best1 + a11)
                came.append((0 if from0 else 1, 0 if from1 else 1))
            best1 += e
        labels = [int(best1 > best0)] if rows else []
        for step in reversed(came):
            labels.append(step[labels[-1]])
        return labels[::-1]


def labelled_pages(count: int, seed: int = 23):
    """``(html, texts of the main blocks)``: pages to learn from."""
    r, letters, serial = random.Random(seed), "abcdefghijklmnoprstuvwé", 0

    def words(low, high):
        nonlocal serial
        serial += 1
        n = r.randrange(low, high)
        text = " ".join("".join(r.choices(letters, k=r.randrange(2, 9))) for _ in range(n)) + f" {serial}x"
        return text.capitalize() + r.choice([".", ".", ".", "", "!", "?"])

    def pick(*options):
        return r.choice(options)

    def tag(name, inner, mark=""):
        return f"<{name}{' ' + mark if mark else ''}>{inner}</{name}>"

    def noise():
        return pick("", "", 'class="row"', 'class="col-8 wrap"', 'id="x12"', 'class="inner"')

    def links(n):
        return "".join(tag("li", tag("a", words(1, 3), f'href="/{i}"')) for i in range(n))

    def prose(keep):
        def block(text):
            keep.append(text)
            return text
        kind = r.random()
        if kind < 0.62:
            inner = block(words(*pick((1, 3), (4, 12), (15, 60), (15, 60))))
            if r.random() < 0.2:
                inner = tag("b", inner)
            return f"<p>{inner}" + ("</p>" if r.random() < 0.85 else "")
        if kind < 0.72:
            return tag(pick("h2", "h3"), block(words(2, 8)))
        if kind < 0.8:
            return tag(pick("ul", "ol"), "".join(tag("li", block(words(2, 14))) for _ in range(3)))
        if kind < 0.85:
            return tag("blockquote", tag("p", block(words(5, 30))))
        if kind < 0.88:
            return tag("pre", block(words(5, 20)))
        if kind < 0.92:
            return tag("table", "".join(tag("tr", tag("td", block(words(1, 4))) + tag("td", block(words(1, 4)))) for _ in range(2)))
        if kind < 0.95:
            return tag("figure", tag("figcaption", block(words(3, 10))))
        return tag("div", block(words(10, 50)), noise())

    def comments():
        one = [lambda: tag("div", tag("p", words(3, 40)), 'class="comment"'), lambda: tag("li", tag("p", words(3, 40)), noise()),
               lambda: tag("article", tag("p", words(3, 40)), 'class="comment"'), lambda: tag("p", words(3, 40))]
        make = r.choice(one)
        name, mark = pick(("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="commentlist"'), ("div", 'class="discussion"'), ("section", 'id="respond"'))
        return tag(name, tag("h3", words(1, 4)) + "".join(make() for _ in range(r.randrange(1, 5))), mark)

    def intruder():
        return pick(
            lambda: tag("div", words(3, 40), pick('class="ad"', 'class="advert"', 'class="ads box"', 'class="sponsored"', 'class="promo"', 'id="ad-1"')),
            lambda: tag("aside", tag("p", words(3, 40)), pick("", 'class="sidebar"', 'class="related"', 'class="widget"')),
            lambda: tag("form", tag("label", words(1, 6)) + tag("p", words(3, 20)) + tag("button", words(1, 3)), pick("", 'class="newsletter"', 'class="search"')),
            lambda: tag("div", tag("p", words(5, 30)), pick('class="cookie-notice"', 'class="notice"', 'class="alert"', 'id="consent"', 'role="dialog"', 'class="banner"', 'class="popup"')),
            lambda: tag("div", tag("ul", links(3)), pick('class="share"', 'class="social"', 'class="related"', 'class="tags"', 'class="recommended"')),
            lambda: tag("div", tag("p", words(3, 20)), pick("hidden", 'style="display:none"')), comments)()

    def top():
        return pick(lambda: tag("nav", tag("ul", links(r.randrange(2, 8)))), lambda: tag("header", tag("h2", words(1, 4)) + tag("p", words(2, 10))),
                    lambda: tag("div", tag("ul", links(4)), pick('class="menu"', 'id="navigation"', 'class="breadcrumbs"', 'class="header"', 'role="navigation"')),
                    lambda: tag("header", tag("nav", tag("ul", links(4))), pick("", 'class="masthead"')))()

    def bottom():
        return pick(lambda: tag("footer", "&copy; " + words(2, 20)), lambda: tag("div", tag("p", words(3, 15)), pick('class="footer"', 'id="foot"', 'class="copyright"', 'role="contentinfo"')),
                    lambda: tag("footer", tag("ul", links(4)) + tag("p", words(3, 20))), intruder, comments)()
    for _ in range(count):
        keep: list[str] = []
        title = words(3, 12)
        inside = []
        if r.random() < 0.8:
            keep.append(title)
            heading = tag("h1", title)
            inside.append(heading if r.random() < 0.85 else tag("div", heading, noise()))
        for _ in range(r.randrange(1, 9)):
            inside.append(prose(keep))
            if r.random() < 0.12:
                inside.append(intruder())
        if r.random() < 0.15:
            inside.append(comments())
        name, mark = pick(("article", ""), ("article", noise()), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'id="main"'), ("div", 'class="entry-content"'),
                          ("section", 'class="article-body"'), ("div", 'class="story text"'))
        body = tag(name, "".join(inside), mark)
        if r.random() < 0.4:
            body = tag(pick("div", "main", "section"), body + (intruder() if r.random() < 0.4 else ""), noise())
        before, after = "".join(top() for _ in range(r.randrange(1, 3))), "".join(bottom() for _ in range(r.randrange(1, 4)))
        if r.random() < 0.5:
            before += intruder()
        yield f"<html><head><title>{title}</title></head><body>{before}{body}{after}</body></html>", keep


@lru_cache(maxsize=2)
def trained(pages: int = 500, steps: int = 100, seed: int = 23) -> Field:
    """The field after learning from labelled pages; the same for the same arguments."""
    examples = []
    for page, keep in labelled_pages(pages, seed):
        blocks, main = blocks_of(page), {" ".join(entities.unescape(k).split()) for k in keep}
        examples.append((features_of(blocks), [int(text in main) for text, _, _ in blocks]))
    field = Field()
    field.fit(examples, steps)
    return field


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page or "")
    return " ".join(b[0] for b, label in zip(blocks, field.decode(features_of(blocks))) if label)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``."""
    field = trained()

    def run(batches):
        for batch in batches:
            texts = [main_text(page, field) for page in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
