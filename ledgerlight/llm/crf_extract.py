"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags.
Features are the tags above a block, the words of their class, id and role attributes
(by group), and the shape of its text. The field has two labels, content and boilerplate;
it is trained on labelled pages (``labelled_pages`` builds them by rule from layouts) by
gradient ascent on the log-likelihood, and decodes by Viterbi. Pages are read row by
row, without a shuffle; the model is a few hundred numbers.
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

from ledgerlight.llm.common import fresh, mapped

# Element names of the HTML standard, by their part in parsing.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
HIDDEN = frozenset(
    "head title script style noscript template textarea select option iframe object svg math canvas audio video".split()
)
HEAD_PARTS = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("script style title textarea noscript iframe".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table article section div main body html aside nav form footer header".split())

TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAME_WORD = re.compile(r"[a-z]+")
GROUPS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs tags skip",
    "head": "header masthead topbar logo banner brand",
    "foot": "footer copyright legal colophon imprint contentinfo",
    "side": "sidebar aside related recommended widget more trending popular rail complementary teaser teasers",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr warning dialog toast paywall",
    "advert": "ad ads advert advertisement adbox sponsor sponsored promo promotion banner commercial outbrain",
    "form": "form search login signup newsletter subscribe subscription register contact",
    "talk": "comment comments reply replies discussion respond disqus thread reader readers feedback",
    "share": "share sharing social follow buttons tools meta byline author",
    "text": "article content post entry main story text body page copy prose paragraph",
}
GROUP_OF = {w: g for g, words in GROUPS.items() for w in words.split()}
BLOCK_TAGS = (
    "article main section aside nav header footer form ul ol li p h1 h2 h3 h4 h5 h6 div td th table blockquote pre"
    " figure figcaption dl dt dd button fieldset details summary address body menu dialog"
).split()
SIZES = (1, 2, 4, 8, 16, 32, 64)


@lru_cache(maxsize=50_000)
def _groups(attributes: str) -> frozenset[str]:
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        for word in NAME_WORD.findall((m.group(1) or m.group(2) or m.group(3) or "").lower()):
            if word in GROUP_OF:
                found.add(GROUP_OF[word])
    return frozenset(found)


@dataclass(frozen=True, eq=False)
class Element:
    """An open element with what its ancestors add up to, so that no leaf walks up to the root."""

    tag: str
    groups: frozenset[str]  # of the element and all above it
    near: frozenset[str]  # of the innermost element that names any
    blocks: frozenset[str]  # tags of the blocks that are open
    parent: str | None  # the innermost of them


ROOT = Element("", frozenset(), frozenset(), frozenset(), None)


def _inside(above: Element, tag: str, own: frozenset[str]) -> Element:
    inline = tag in INLINE
    return Element(
        tag, above.groups | own if own - above.groups else above.groups, own or above.near,
        above.blocks if inline or tag in above.blocks else above.blocks | {tag}, above.parent if inline else tag,
    )


@dataclass
class Leaf:
    text: str
    above: Element
    linked: int  # characters inside links


@dataclass
class _Reader:
    """Open elements as a stack; for each name the places where it is open, so none is searched for."""

    leaves: list[Leaf] = field(default_factory=list)
    stack: list[Element] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)
    blocks: list[int] = field(default_factory=list)  # places of elements that are not inline
    parts: list[str] = field(default_factory=list)
    above: Element | None = None
    hidden: int = 0
    links: int = 0
    linked: int = 0

    def last(self, tag: str) -> int:
        """Place of the innermost open ``tag``, -1 if there is none."""
        at = self.places.get(tag)
        return at[-1] if at else -1

    def text(self, raw: str) -> None:
        if self.hidden and not raw.isspace():
            self.leave_head()
        if self.hidden or not raw:
            return
        if not self.parts or self.above is None:
            self.above = self.stack[-1] if self.stack else None
        self.parts.append(raw)
        if self.links:
            self.linked += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.leaves.append(Leaf(text, self.above or ROOT, self.linked))
        self.parts, self.above, self.linked = [], None, 0

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"

    def leave_head(self) -> None:
        """Close an open head, as text and all that may not stand in one do; not from inside its templates."""
        heads = self.places.get("head")
        if heads and max(self.last("template"), self.last("noframes")) < heads[0]:
            self.pop_to(heads[0])

    def open(self, tag: str, attributes: str) -> None:
        if self.hidden and tag not in HEAD_PARTS:
            self.leave_head()
        if tag not in INLINE:
            self.flush()
            if tag not in HIDDEN:
                self.imply(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "math"):
            return
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(_inside(self.stack[-1] if self.stack else ROOT, tag, _groups(attributes) if attributes else frozenset()))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def imply(self, tag: str) -> None:
        """Close what the start of ``tag`` closes: an open paragraph, a sibling item or cell."""
        place = max(self.last(name) for name in ("p", *CLOSES.get(tag, ())))
        if place >= 0 and place > max(self.last(name) for name in BARRIER):
            self.pop_to(place)

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        place = self.last(tag)
        if place >= 0 and (tag not in INLINE or not self.blocks or place > self.blocks[-1]):
            self.pop_to(place)


def leaves(page: str | None) -> list[Leaf]:
    """Leaf blocks in page order, references decoded, white space single; none for null or empty."""
    if not page:
        return []
    reader, at = _Reader(), 0
    find = TAG.search
    while (m := find(page, at)) is not None:
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            reader.close(tag)
            continue
        reader.open(tag, m.group(3) or m.group(6) or "")
        if tag in RAW:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
    if at < len(page):
        reader.text(page[at:])
    reader.flush()
    return reader.leaves


NAMES = (
    [f"above={t}" for t in BLOCK_TAGS] + [f"parent={t}" for t in BLOCK_TAGS] + [f"group={g}" for g in GROUPS] + [f"near={g}" for g in GROUPS]
    + [f"size={s}" for s in SIZES] + ["links=0", "links=some", "links=most", "end=stop", "comma", "sign=copyright",
       "first", "last", "bias"]
)
INDEX = {n: k for k, n in enumerate(NAMES)}
_ABOVE = {t: INDEX[f"above={t}"] for t in BLOCK_TAGS}
_PARENT = {t: INDEX[f"parent={t}"] for t in BLOCK_TAGS}
_GROUP = {g: INDEX[f"group={g}"] for g in GROUPS}
_NEAR = {g: INDEX[f"near={g}"] for g in GROUPS}
_SIZE = [INDEX[f"size={s}"] for s in SIZES]


def active(leaf: Leaf, first: bool, last: bool) -> list[int]:
    """Indices of the features that hold for a leaf."""
    above = leaf.above
    out = [_ABOVE[t] for t in above.blocks if t in _ABOVE]
    if above.parent in _PARENT:
        out.append(_PARENT[above.parent])
    out += [_GROUP[g] for g in above.groups]
    out += [_NEAR[g] for g in above.near]
    text = leaf.text
    count = text.count(" ") + 1
    out += [i for i, s in zip(_SIZE, SIZES) if count >= s]
    share = leaf.linked / len(text)
    out.append(INDEX["links=0"] if not leaf.linked else INDEX["links=most"] if share > 0.6 else INDEX["links=some"])
    if text[-1] in ".!?…\"”»":
        out.append(INDEX["end=stop"])
    if ", " in text:
        out.append(INDEX["comma"])
    if "©" in text:
        out.append(INDEX["sign=copyright"])
    if first:
        out.append(INDEX["first"])
    if last:
        out.append(INDEX["last"])
    out.append(INDEX["bias"])
    return out


@dataclass(frozen=True)
class Field:
    """Weights of (feature, label) and of (label, next label); label 1 is content."""

    state: np.ndarray
    step: np.ndarray


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 300, penalty: float = 0.003, rate: float = 0.1) -> Field:
    """Maximum-likelihood field with a quadratic penalty, by adaptive gradient steps.

    ``pages`` hold the active features and the label of every leaf; pages without leaves
    add nothing.
    """
    pages = [p for p in pages if p[1]]
    longest, total = max(len(y) for _, y in pages), len(pages)
    x = np.zeros((total, longest, len(NAMES)))
    y = np.zeros((total, longest), dtype=np.int64)
    real = np.zeros((total, longest), dtype=bool)
    for k, (features, labels) in enumerate(pages):
        for t, idx in enumerate(features):
            x[k, t, idx] = 1.0
        y[k, : len(labels)] = labels
        real[k, : len(labels)] = True
    state, step = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(state), np.zeros_like(state), np.zeros_like(step), np.zeros_like(step)]
    truth = np.eye(2)[y] * real[..., None]
    seen_state = np.einsum("ktf,ktl->fl", x, truth)
    seen_step = np.einsum("kta,ktb->ab", truth[:, :-1], truth[:, 1:])
    for turn in range(1, rounds + 1):
        emit = (x @ state) * real[..., None]
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(step + (emit[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        norm = np.logaddexp.reduce(ahead[:, -1], axis=1)
        single = np.exp(ahead + back - norm[:, None, None]) * real[..., None]
        pair = np.exp(
            ahead[:, :-1, :, None] + step + (emit + back)[:, 1:, None, :] - norm[:, None, None, None]
        ) * real[:, 1:, None, None]
        grads = (
            (seen_state - np.einsum("ktf,ktl->fl", x, single)) / total - penalty * state,
            (seen_step - pair.sum(axis=(0, 1))) / total - penalty * step,
        )
        for k, (weights, g) in enumerate(zip((state, step), grads)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(state, step)


def decode(model: Field, features: list[list[int]]) -> list[int]:
    """The likeliest labels (Viterbi); ties go to boilerplate."""
    (s00, s01), (s10, s11) = model.step.tolist()
    bad, good = model.state[:, 0].tolist(), model.state[:, 1].tolist()
    a = b = 0.0
    back = []
    for k, idx in enumerate(features):
        ea, eb = sum(bad[i] for i in idx), sum(good[i] for i in idx)
        if k:
            from_a, from_b = b + s10 > a + s00, b + s11 > a + s01
            back.append((from_a, from_b))
            a, b = (b + s10 if from_a else a + s00) + ea, (b + s11 if from_b else a + s01) + eb
        else:
            a, b = ea, eb
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1] if features else []


def featured(found: list[Leaf]) -> list[list[int]]:
    return [active(x, k == 0, k + 1 == len(found)) for k, x in enumerate(found)]


MARK = "\ue000"  # a private character in front of every content text while labels are read off
_BOILERPLATE = (
    "<nav><ul>{links}</ul></nav>", '<div class="menu">{links}</div>', '<div id="top-nav"><ul>{links}</ul></div>',
    "<header><div>{few}</div></header>", "<header><h1>{few}</h1><nav>{links}</nav></header>", '<header class="top"><h1>{short}</h1></header>',
    '<header class="site-header"><a href="/">{few}</a><p>{short}</p></header>',
    '<div class="ad">{sentence}</div>', '<div class="advert"><p>{sentence}</p></div>', '<div class="sponsored">{long}</div>',
    '<aside><h3>{few}</h3><p>{sentence}</p></aside>', '<div class="sidebar"><h2>{few}</h2><ul>{links}</ul><p>{long}</p></div>',
    '<div class="cookie-notice"><p>{sentence}</p><button>{few}</button></div>', '<div role="alert">{sentence}</div>',
    '<div class="notice"><p>{long}</p></div>', "<form><label>{few}</label><input><button>{few}</button></form>",
    '<form action="/s"><p>{sentence}</p><input></form>', '<div class="newsletter"><p>{sentence}</p></div>',
    '<div class="related"><h4>{few}</h4><ul>{links}</ul></div>', '<div class="share">{links}</div>',
)
_ENDS = (
    '<div class="comments"><article class="comment">{long}</article><article class="comment">{sentence}</article></div>',
    '<div id="respond"><p>{short}</p><form><label>{few}</label></form></div>', '<div id="secondary" class="widget-area"><p>{long}</p></div>',
    "<div>© {short}</div>",
    '<section class="comments"><h2>{few}</h2><article class="comment"><p>{long}</p></article></section>',
    '<div id="comments"><div class="comment"><p>{long}</p><p>{sentence}</p></div><p>{sentence}</p></div>',
    '<ol class="comment-list"><li><p>{long}</p></li><li><p>{sentence}</p></li></ol>',
    "<footer>© {sentence}</footer>", "<footer><p>{short}</p><ul>{links}</ul></footer>", '<div class="footer">{sentence}</div>',
    "<footer>{long}</footer>", '<div id="copyright">© {short}</div>',
)
_HOLDERS = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"), ('<div id="main-content"><div class="post">', "</div></div>"),
    ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("", ""), ('<div id="page"><div class="entry">', "</div></div>"),
    ("<article class='post'>", "</article>"), ('<section class="entry-content">', "</section>"), ('<div class="article-body">', "</div>"), ('<div class="story">', "</div>"),
)
_CONTENT = (
    "<p>{long}</p>", "<p>{long}", "<p>{sentence}</p>", "<p>{short}", "<h2>{short}</h2>", "<p><b>{sentence}<br>",
    "<ul>{items}</ul>", "<blockquote>{long}</blockquote>", '<p>{sentence} <a href="/x">{few}</a> {sentence}</p>',
    "<pre>{sentence}</pre>", "<p>{few}</p>", "<table><tr><td>{few}</td><td>{short}</td></tr></table>", "<div>{long}</div>",
)


def labelled_pages(count: int = 400, seed: int = 3) -> list[tuple[str, list[int]]]:
    """Pages laid out by rule, with the label of every leaf; the same for a seed."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfglmnprst" for b in ("a", "e", "io", "u", "en", "ar")]

    def words(low: int, high: int, mark: str) -> str:
        made = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high))]
        return mark + " ".join(w + rng.choice(("", "", "", "", ",")) for w in made)

    def fill(form: str, mark: str) -> str:
        stop = rng.choice((".", ".", ".", "!", "?", "***", ""))
        values = {
            "few": words(1, 3, mark), "short": words(3, 8, mark), "sentence": words(6, 18, mark) + stop,
            "long": words(20, 90, mark) + stop,
            "links": "".join(f'<li><a href="/x">{words(1, 3, mark)}</a></li>' for _ in range(rng.randint(2, 6))),
            "items": "".join(f"<li>{words(2, 12, mark)}</li>" for _ in range(rng.randint(2, 5))),
        }
        return form.format(**values)

    pages = []
    for _ in range(count):
        start, stop = rng.choice(_HOLDERS)
        title = rng.choice(("<h1>{short}</h1>",) * 4 + ("<header><h1>{short}</h1></header>", ""))
        inner = [fill(title, MARK)] if title else []
        inner += [fill(rng.choice(_CONTENT), MARK) for _ in range(rng.randint(1, 9))]
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):  # adverts and the like between the paragraphs
            inner.insert(rng.randint(min(1, len(inner)), len(inner)), fill(rng.choice(_BOILERPLATE[7:]), ""))
        before = [fill(f, "") for f in rng.sample(_BOILERPLATE, rng.randint(0, 4))]
        after = [fill(f, "") for f in rng.sample(_BOILERPLATE[7:], rng.randint(0, 2)) + rng.sample(_ENDS, rng.randint(0, 3))]
        page = f"<html><body>{''.join(before)}{start}{''.join(inner)}{stop}{''.join(after)}</body></html>"
        found = leaves(page)
        pages.append((page.replace(MARK, ""), [int(x.text.startswith(MARK)) for x in found]))
    return pages


def fit(pages: list[tuple[str, list[int]]] | None = None) -> Field:
    """Field trained on (page, label of every leaf); by default on ``labelled_pages()``."""
    return train([(featured(leaves(p)), y) for p, y in (labelled_pages() if pages is None else pages)])


def main_text(page: str | None, model: Field) -> str:
    found = leaves(page)
    return " ".join(x.text for x, y in zip(found, decode(model, featured(found))) if y)


def extract(pages: DataFrame, model: Field, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in the column ``name`` in place of ``html_col``.

    Null and empty pages, and pages without content, give the empty text. Whole pages
    are read; repeated rows give repeated rows; an empty table stays empty. A column that
    is already called ``name`` is replaced, all others stay.
    """
    kept = [c for c in pages.columns if c.lower() not in (html_col.lower(), name.lower())]
    own = fresh(kept, "_html_")
    source = pages.select(*kept, F.col(html_col).cast("string").alias(own))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = source.withColumnRenamed(own, name).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [main_text(p, m) for p in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=schema.names)

    return mapped(source, run, schema)
