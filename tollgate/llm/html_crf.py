"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut at the tags of block elements; each piece of text between two of them is a
leaf block with a chain of ancestors. Features are the ancestors' tags and class words,
and length, links, punctuation and place of the text. The field has two labels (main
text, other) and is trained on labelled pages by gradient ascent of the conditional
likelihood; Viterbi decoding labels the blocks of a page together. The main text is the
text of the main blocks in page order.

Labelled pages are a sample of at most ``FIT_PAGES`` pages that mark their article, and
``VARIANTS`` rearrangements of each, in which the same blocks stand in other layouts
(menus, sidebars, notices, adverts, forms, comments, plain containers), so that no
single layout is learnt by heart. The sample bounds training only; every page is
decoded whole.

Defined cases: a null or empty page has the empty text; text outside all elements is a
block; an element that is never closed ends with the page or its parent; scripts,
styles, templates, frames, drawings, comments and declarations are no text, also unclosed;
formulas, the content of ``object`` and of ``noscript`` are text like any other; repeated rows give
repeated results; pages without any marked article train on a built-in sentence; only
``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 240
VARIANTS = 3
ROUNDS = 150
RATE = 0.08
RIDGE = 1e-4
SEED = 5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # a self-closing svg holds nothing; the other raw elements have no such form
    r"""|<svg(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<=/)>"""
    r"""|<(?P<raw>script|style|template|iframe|svg|annotation|annotation-xml)(?=[\s/>])(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>).*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"""
    r"|<[!?][^>]*+(?:>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attributes2>[^>]*+)(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
#: The name stands at the start, or behind white space, a slash or another attribute's quotes; never inside a longer name.
ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|data-main)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
NAME_WORD = re.compile(r"[a-z]+")
# Fixed values of the markup language: elements without content, elements inside a line, elements that end their like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of formulas: inside a line, and the only ones there that "/>" closes.
FORMULA = frozenset("math maction menclose merror mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = FORMULA | frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are a block of their own within a paragraph and do not end it; so are those with a hyphen in their name.
HELD = frozenset("noscript object".split())
ENDS_LIKE = {t: frozenset(o) for t, o in {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}.items()}
LISTS = frozenset("ul ol dl table select tbody thead tfoot".split())
#: Words in class and id names that usually tell what a container holds.
OTHER_NAMES = frozenset(
    "nav menu header footer sidebar aside ad ads advert advertisement promo sponsor sponsored cookie cookies consent notice banner comment comments reply replies respond form login signup subscribe newsletter share social related breadcrumb popup modal widget toolbar pagination copyright disclaimer".split()
)
MAIN_NAMES = frozenset("article content post entry main story body text".split())
SKIPPED = frozenset("title textarea button select option".split())


class Element:
    """An open element: what it adds to the names of its ancestors, and a way up."""

    __slots__ = ("tag", "words", "parent", "new", "score")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Element | None, new: list[str]):
        self.tag, self.words, self.parent, self.new = tag, words, parent, new
        self.score: float | None = None

    def line(self) -> list[Element]:
        """This element and its ancestors, the outermost first."""
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.parent
        return out[::-1]


@dataclass
class Leaf:
    text: str
    element: Element | None
    linked: int
    marked: bool

    @property
    def chain(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """Tag and name words of the ancestors that are no part of a line."""
        return tuple((e.tag, e.words) for e in self.element.line()) if self.element else ()


def attributes(text: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id and role names, and whether the element carries a training label."""
    words, marked = [], False
    for name, value in ATTRIBUTE.findall(text):
        if name.lower() == "data-main":
            marked = True
        else:
            words += NAME_WORD.findall(value.lower())
    return tuple(words), marked


def names_of(tag: str, words: tuple[str, ...]) -> list[str]:
    """Feature names that an element gives to every block inside it."""
    names = [f"in {tag}", *(f"named {w}" for w in words)]
    if OTHER_NAMES.intersection(words):
        names.append("hint other")
    if MAIN_NAMES.intersection(words):
        names.append("hint main")
    return names


class Open:
    """The open elements at a place of a page. Every question takes the same time at any depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, list[str]]] = []
        self.at: dict[str, list[int]] = {}  # places of each tag
        self.blocks: list[int] = []  # places of elements that are no part of a line
        self.lists: list[int] = []
        self.elements: list[Element] = []
        self.counts: dict[str, int] = {}  # feature names
        self.marked = self.skipped = 0

    def push(self, tag: str, words: tuple[str, ...], marked: bool) -> None:
        place = len(self.stack)
        self.at.setdefault(tag, []).append(place)
        self.marked += marked
        self.skipped += tag in SKIPPED
        names: list[str] = []
        if tag not in INLINE:
            self.blocks.append(place)
            names = list(dict.fromkeys(names_of(tag, words)))
            new = [n for n in names if not self.counts.get(n)]
            self.elements.append(Element(tag, words, self.elements[-1] if self.elements else None, new))
            for n in names:
                self.counts[n] = self.counts.get(n, 0) + 1
        if tag in LISTS:
            self.lists.append(place)
        self.stack.append((tag, marked, names))

    def cut(self, place: int) -> None:
        """Close everything from a place on."""
        while len(self.stack) > place:
            tag, marked, names = self.stack.pop()
            self.at[tag].pop()
            self.marked -= marked
            self.skipped -= tag in SKIPPED
            if tag not in INLINE:
                self.blocks.pop()
                self.elements.pop()
                for n in names:
                    self.counts[n] -= 1
            if tag in LISTS:
                self.lists.pop()

    def close(self, tag: str) -> None:
        if self.at.get(tag):
            self.cut(self.at[tag][-1])

    def make_way(self, tag: str) -> None:
        """Close what the start of a block element ends: a paragraph, or its like within the same list."""
        ends = ENDS_LIKE.get(tag, ())
        place = max((self.at[t][-1] for t in ("p", *ends) if self.at.get(t)), default=-1)
        border = (self.lists[-1] + 1 if self.lists else 0) if ends else (self.blocks[-1] if self.blocks else 0)
        if place >= max(border, 0):
            self.cut(place)


def leaves(page: str | None) -> list[Leaf]:
    """The leaf blocks of a page, in page order."""
    page = page or ""
    now = Open()
    found: list[Leaf] = []
    parts: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text and not now.skipped:
                found.append(Leaf(text, now.elements[-1] if now.elements else None, linked, now.marked > 0))
        linked = 0

    def words(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if now.at.get("a"):
            linked += len(piece.strip())

    for token in TOKEN.finditer(page):
        if token.start() > at:
            words(page[at : token.start()])
        at = token.end()
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if token["close"] or token["close2"]:
            now.close(tag)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and tag not in HELD and "-" not in tag:
            now.make_way(tag)
        text = token["attributes"] or token["attributes2"] or ""
        if not text.rstrip().endswith("/") or tag in INLINE and tag not in FORMULA:
            now.push(tag, *(attributes(text) if text else ((), False)))
    if at < len(page):
        words(page[at:])
    flush()
    return found


def own_features(blocks: list[Leaf]) -> list[list[str]]:
    """Names of the features of each block's text and place."""
    out = []
    for n, block in enumerate(blocks):
        text = block.text
        share = block.linked / len(text)
        own = [
            f"leaf {block.element.tag if block.element else 'none'}",
            f"length {min(len(text) // 8, 1 << 20).bit_length()}",
            f"links {0 if share == 0 else 1 if share < 0.5 else 2}",
            "sentence" if text[-1] in ".!?…。！？\"'" else "no sentence",
            f"commas {min(text.count(','), 3)}",
            f"place {n * 6 // len(blocks)}",
            "bias",
        ]
        if "©" in text[:40] or "copyright" in text[:40].lower():
            own.append("copyright")
        out.append(own)
    return out


def features(blocks: list[Leaf]) -> list[list[str]]:
    """Names of all features of each block: those of its ancestors and its own."""
    kept: dict[int, list[str]] = {}
    out = []
    for block, own in zip(blocks, own_features(blocks), strict=True):
        above = kept.get(id(block.element))
        if above is None:
            above = kept[id(block.element)] = sorted(n for e in (block.element.line() if block.element else ()) for n in e.new)
        out.append([*above, *own])
    return out


class Field:
    """Two-label linear chain: weights per feature, one weight per transition, one for the first label."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros(0)
        self.transitions = np.zeros((2, 2))
        self.first = 0.0

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS) -> None:
        """Gradient ascent (Adam) of the conditional likelihood of all labelled pages."""
        pages = [p for p in pages if p[1]]
        for rows, _ in pages:
            for names in rows:
                for name in names:
                    self.index.setdefault(name, len(self.index))
        longest, count = max(len(y) for _, y in pages), len(pages)
        mask = np.zeros((count, longest), bool)
        truth = np.zeros((count, longest), np.int64)
        cell, feature = [], []
        for p, (rows, y) in enumerate(pages):
            mask[p, : len(y)] = True
            truth[p, : len(y)] = y
            for t, names in enumerate(rows):
                feature += [self.index[x] for x in names]
                cell += [p * longest + t] * len(names)
        cell, feature = np.asarray(cell), np.asarray(feature)
        size = len(self.index)
        theta = np.zeros(size + 5)
        one, two = np.zeros_like(theta), np.zeros_like(theta)
        rows = np.arange(count)
        lengths = mask.sum(1)
        pair = mask[:, 1:]
        observed = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                observed[a, b] = ((truth[:, :-1] == a) & (truth[:, 1:] == b) & pair).sum()
        for step in range(1, rounds + 1):
            emission = np.zeros((count, longest, 2))
            emission[:, :, 1] = np.bincount(cell, theta[feature], count * longest).reshape(count, longest)
            emission[:, 0, 1] += theta[size]
            moves = theta[size + 1 :].reshape(2, 2)
            forward = np.zeros_like(emission)
            forward[:, 0] = emission[:, 0]
            for t in range(1, longest):
                forward[:, t] = np.logaddexp(forward[:, t - 1, 0, None] + moves[0], forward[:, t - 1, 1, None] + moves[1]) + emission[:, t]
            backward = np.zeros_like(emission)
            for t in range(longest - 2, -1, -1):
                after = backward[:, t + 1] + emission[:, t + 1]
                value = np.logaddexp(moves[:, 0] + after[:, 0, None], moves[:, 1] + after[:, 1, None])
                backward[:, t] = np.where(mask[:, t + 1, None], value, 0.0)
            end = forward[rows, lengths - 1]
            total = np.logaddexp(end[:, 0], end[:, 1])
            main = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * mask
            error = (truth * mask - main).ravel()
            gradient = np.zeros_like(theta)
            gradient[:size] = np.bincount(feature, error[cell], size)
            gradient[size] = error.reshape(count, longest)[:, 0].sum()
            for a in (0, 1):
                for b in (0, 1):
                    joint = forward[:, :-1, a] + moves[a, b] + emission[:, 1:, b] + backward[:, 1:, b] - total[:, None]
                    gradient[size + 1 + 2 * a + b] = observed[a, b] - (np.exp(joint) * pair).sum()
            gradient = gradient / count - RIDGE * theta
            one += 0.1 * (gradient - one)
            two += 0.001 * (gradient * gradient - two)
            theta += RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
        self.weights, self.first = theta[:size].copy(), float(theta[size])
        self.transitions = theta[size + 1 :].reshape(2, 2).copy()

    def weigh(self, element: Element | None) -> float:
        """The weight of all features of an element and its ancestors; each element is weighed once."""
        waiting = []
        while element is not None and element.score is None:
            waiting.append(element)
            element = element.parent
        score = 0.0 if element is None else element.score
        for e in reversed(waiting):
            score += sum(float(self.weights[i]) for i in map(self.index.get, e.new) if i is not None)
            e.score = score
        return score

    def label(self, blocks: list[Leaf]) -> list[int]:
        """The most probable labels of the blocks of a page."""
        return self.decode(own_features(blocks), [self.weigh(b.element) for b in blocks])

    def decode(self, rows: list[list[str]], above: list[float] | None = None) -> list[int]:
        """The most probable labels (Viterbi); ``above`` is what ancestors add to each row."""
        if not rows:
            return []
        get, weights = self.index.get, self.weights.tolist()
        (m00, m01), (m10, m11) = self.transitions.tolist()
        back = []
        zero = one = 0.0
        for t, names in enumerate(rows):
            score = sum([weights[i] for i in map(get, names) if i is not None]) + (above[t] if above else 0.0)
            if t == 0:
                zero, one = 0.0, score + self.first
                continue
            from_one = one + m10 > zero + m00, one + m11 > zero + m01
            back.append(from_one)
            zero, one = max(zero + m00, one + m10), max(zero + m01, one + m11) + score
        label = int(one > zero)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def extract(page: str | None, field: Field) -> str:
    """The main text of one page."""
    blocks = leaves(page)
    labels = field.label(blocks)
    return " ".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def natural_labels(blocks: list[Leaf]) -> list[int]:
    """Labels of a page that marks its article: inside it, and inside nothing that usually holds other text."""
    out = []
    for block in blocks:
        tags = [tag for tag, _ in block.chain]
        inside = [i for i, tag in enumerate(tags) if tag in ("article", "main")]
        below = block.chain[inside[0] + 1 :] if inside else ()
        other = any(t in ("nav", "aside", "footer", "form", "header") or OTHER_NAMES.intersection(w) for t, w in below)
        out.append(int(bool(inside) and not other))
    return out


def rearranged(main: list[str], other: list[str], rng: np.random.Generator) -> str:
    """A page with the same blocks in a layout drawn at random; main blocks carry the label."""

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    def some(n: int, longest: int = 2000) -> list[str]:
        pool = [x for x in other + main if len(x) <= longest] or ["notice"]
        return [entities.escape(pool[rng.integers(len(pool))]) for _ in range(n)]

    def short(n: int) -> list[str]:
        return [" ".join(x.split()[: int(rng.integers(1, 6))]) or "more" for x in some(n)]

    def element(opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate(short(n)))

    def paragraphs(n: int) -> str:
        return "".join(f"<p>{x}</p>" for x in some(n))

    def extra() -> str:
        kind = rng.integers(8)
        if kind == 0:
            return element(pick("aside", 'aside class="related"', 'div class="sidebar"', 'div class="related-posts"'), element("h3", short(1)[0]) + pick("<ul>" + links(4) + "</ul>", paragraphs(2)))
        if kind == 1:
            return element(pick('div class="ad"', 'div class="advertisement"', 'div id="ad-top"', 'section class="sponsored"', 'ins class="ads"'), pick(short(1)[0], paragraphs(1), some(1)[0]))
        if kind == 2:
            return element(pick('div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div role="alert" class="consent"'), pick(paragraphs(1), some(1)[0]))
        if kind == 3:
            return element(pick("form", 'form class="newsletter"', 'div class="subscribe-form"'), f"<label>{short(1)[0]}</label><input><p>{some(1)[0]}</p><button>ok</button>")
        if kind == 4:
            return element(pick('section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="replies"'), "".join(element(pick('div class="comment"', 'li class="comment"', "article class=\"comment\""), f"<h4>{short(1)[0]}</h4><p>{x}</p>") for x in some(int(rng.integers(1, 5)))))
        if kind == 5:
            return element(pick('div class="share"', 'div class="social-share"', 'nav class="breadcrumb"'), "<ul>" + links(3) + "</ul>")
        if kind == 6:
            return element("aside", paragraphs(2))
        return ""

    body = []
    plain = rng.random() < 0.25  # a page that knows one kind of container only
    for n, text in enumerate(main):
        tag = pick("h1", "div") if plain and n == 0 else "div" if plain else "h1" if n == 0 and len(text) < 200 else pick("p", "p", "p", "p", "h2", "li", "blockquote") if len(text) > 20 else "p"
        body.append(f'<{tag} data-main="1">{entities.escape(text)}</{tag}>')
        if rng.random() < 0.08:
            body.append(extra())
    tail = "".join(extra() for _ in range(rng.integers(0, 3)))
    opening = "div" if plain else pick("article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post"', 'section class="entry-content"', "div")
    parts = [
        pick("", element(pick("header", 'div class="header"', 'div id="top-banner"'), element("h2", short(1)[0]) + pick("", paragraphs(1)))),
        pick("", element(pick("nav", 'div class="menu"', 'ul id="nav"'), pick("<ul>", "<ol>") + links(int(rng.integers(3, 12))) + "</ul>")),
        extra(),
        element(opening, "".join(body) + (tail if rng.random() < 0.5 else "")),
        "" if rng.random() < 0.5 else tail,
        extra(),
        element(pick("footer", 'div class="footer"', 'div id="footer"'), pick("&copy; " + some(1, 200)[0], paragraphs(1), paragraphs(2), "<ul>" + links(3) + "</ul>")),
    ]
    return element("html", element("body", "".join(parts)))


SENTENCE = "The quick report, written in one go, says what happened and why it matters to those who read it."


def train(pages: DataFrame, seed: int = SEED) -> Field:
    """The field for these pages, from a bounded sample of those that mark their article."""
    rng = np.random.default_rng(seed)
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")).select("html")
    # twice as many as needed, by hash, so that only those are compared and sent
    share = min(1.0, 2 * FIT_PAGES / max(1, marked.count()))
    highest = min((1 << 63) - 1, int((2 * share - 1) * (1 << 63)))
    near = marked.where(F.xxhash64("html") <= F.lit(highest)).distinct()
    sample = [r["html"] for r in near.orderBy(F.xxhash64("html"), "html").limit(FIT_PAGES).collect()]
    labelled = []
    for page in sample or [f"<nav><a>menu</a></nav><article><h1>Report</h1><p>{SENTENCE}</p><p>{SENTENCE}</p></article><footer>&copy; site</footer>"] * 8:
        blocks = leaves(page)
        truth = natural_labels(blocks)
        labelled.append((features(blocks), truth))
        main = [b.text for b, y in zip(blocks, truth, strict=True) if y]
        other = [b.text for b, y in zip(blocks, truth, strict=True) if not y]
        for _ in range(VARIANTS if main else 0):
            made = leaves(rearranged(main, other, rng))
            labelled.append((features(made), [int(b.marked) for b in made]))
    field = Field()
    field.fit(labelled)
    return field


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, the main text and its length in code points of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(field or train(pages))

    def task(batches):
        own = shared.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [extract(page, own) for page in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return held.mapInArrow(task, "page_id long, url string, text string, n_chars long")
