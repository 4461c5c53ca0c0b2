"""Main text of web pages by a linear-chain conditional random field.

A page is cut into its DOM leaf blocks: stretches of text that no block element divides.
Each block has features of its ancestors (tags, the words of their class, id and role)
and of its text (size, share of links, marks). The field scores a label, main text or
not, for every block and for every two neighbours; it is trained by maximum likelihood
(forward-backward) on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.llm.common import with_package
from workboard.llm.labelled_pages import labelled_pages

# Fixed values of HTML: what has no end tag, what starts a new block, what shows no text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p
    pre section select summary table tbody td tfoot th thead title tr ul label""".split())
_NO_TEXT = frozenset("script style title".split())
#: Shown no text when their own end tag is there; what follows an unclosed one is no part of it, and stays.
_HIDDEN = _NO_TEXT | frozenset("head noscript template svg iframe object textarea select datalist".split())
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: An opening tag ends these open ones, up to the given limits.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tr": ({"tr"}, {"table"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = _BLOCK - {"body", "html", "head", "title", "button", "label", "legend", "option", "select", "td", "th", "tr",
                    "tbody", "thead", "tfoot", "caption"}
_P_LIMITS = _HIDDEN | {"td", "th", "table", "button", "body"}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=4096)
def value_features(value: str) -> frozenset:
    """The words of a whole class, id or role, and the beginnings of long ones."""
    words = {x.lower() for x in _PARTS.findall(value)}
    return frozenset(f"word={x}" for x in words) | {f"stem={x[:5]}" for x in words if len(x) > 5}


class Element:
    """An open element: its features, those that no ancestor has (``new``), and what it inherits.
    A path is the chain of parents; its features are the ``new`` ones along it."""
    __slots__ = ("tag", "parent", "found", "new", "mark", "in_article", "hidden", "score")

    def __init__(self, tag: str, parent: "Element | None", found: frozenset, new: tuple, mark: str | None, hidden: tuple | None):
        self.tag, self.parent, self.found, self.new, self.hidden = tag, parent, found, new, hidden
        self.mark = mark if mark is not None or parent is None else parent.mark
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article
        self.score = None  # the weights of the path's features, once they are summed


@dataclass(slots=True)
class Block:
    text: str
    at: Element | None   # the innermost open element
    linked: int          # characters within links

    @property
    def mark(self) -> str | None:
        """data-main of the nearest element that has it."""
        return self.at.mark if self.at else None


class _Blocks(HTMLParser):
    """Every step costs no more than what it opens or closes: each tag's open places are kept, so that
    nothing searches the open elements, and an element knows its parent and its own features only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}   # by tag, and "heading" and "block" (other than p)
        self.seen: dict[str, int] = {}           # by feature, how many open elements have it
        self.parts: list[str] = []
        self.linked = 0

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    @staticmethod
    def kinds(tag: str) -> list[str]:
        return [tag] + ["heading"] * (tag in _HEADINGS) + ["block"] * (tag in _BLOCK and tag != "p")

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.open[-1] if self.open else None, self.linked))
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
        self.leave_head(tag)
        if tag in _BLOCK:
            if tag in _CLOSES:
                self.close_until(*_CLOSES[tag])
            elif tag in _ENDS_P:
                self.close_until({"p"}, _P_LIMITS | {"block"})
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        found, mark = {f"tag={tag}"}, None
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                found |= value_features(value)
            elif name == "data-main":
                mark = value
        hidden = (len(self.blocks), self.parts, len(self.parts), self.linked) if tag in _HIDDEN else None
        seen = self.seen
        new = tuple(sorted(f for f in found if not seen.get(f)))
        for f in found:
            seen[f] = seen.get(f, 0) + 1
        for kind in self.kinds(tag):
            self.places.setdefault(kind, []).append(len(self.open))
        self.open.append(Element(tag, self.open[-1] if self.open else None, frozenset(found), new, mark, hidden))

    def leave_head(self, tag):
        """``</head>`` may be left out: the body, or what can't stand in a head, ends it; so does
        a block element with an unclosed title."""
        if tag == "body":
            self.close_until({"head"}, {"template"})
        if self.open and self.open[-1].tag == "title" and tag in _BLOCK:
            self.close_at(len(self.open) - 1)
        if self.open and self.open[-1].tag == "head" and tag not in _IN_HEAD:
            self.flush()
            self.close_at(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        at = self.last("heading" if tag in _HEADINGS else tag)
        wall = -1 if tag in ("table", "body", "html") else max(self.last("table"), self.last("body"))
        if at >= 0 and at >= wall:
            self.close_at(at, True)

    def close_until(self, tags, limits):
        at = max(map(self.last, tags))
        if at >= 0 and at > max(self.last(x) for x in limits - tags):
            self.close_at(at)

    def close_at(self, at, ended=False):
        """``ended``: by the end tag of the element there, not by that of another one."""
        for element in self.open[at:]:
            if element.hidden and (ended or element.tag in _NO_TEXT):
                blocks, self.parts, size, self.linked = element.hidden
                del self.blocks[blocks:], self.parts[size:]
                break
            ended = False
        for element in self.open[at:]:
            for kind in self.kinds(element.tag):
                self.places[kind].pop()
            for f in element.found:
                self.seen[f] -= 1
        del self.open[at:]

    def handle_data(self, data):
        if self.open and self.open[-1].tag == "head" and data.strip():
            self.flush()
            self.close_at(len(self.open) - 1)
        self.parts.append(data)
        if self.places.get("a"):
            self.linked += len(data)


def blocks_of(html: str) -> list[Block]:
    """Leaf blocks in page order, white space folded, character references decoded."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    if parser.open:
        parser.close_at(0)
    return parser.blocks


def path_features(block: Block) -> set[str]:
    """Every open element's tag and words, and the innermost element once more."""
    out, element = set(), block.at
    if element is not None:
        out |= {"in:" + x for x in element.found}
    while element is not None:
        out.update(element.new)
        element = element.parent
    return out


def text_features(block: Block) -> set[str]:
    """Size, share of links and marks of the text; apart for blocks within an article or
    main element, where even a single word may be a paragraph."""
    text = block.text
    n = len(text)
    out = {"bias", f"size={min(9, n.bit_length())}", f"links={4 * min(block.linked, n) // n}"}
    if text[-1] in ".!?":
        out.add("ends")
    if "©" in text:
        out.add("copyright")
    if n < 60 and " " not in text:
        out.add("one word")
    if block.at is not None and block.at.in_article:
        out = {"article:" + x for x in out}
    return out


# ---------------------------------------------------------------- the field

@dataclass
class Field:
    """Two labels: 1 is main text. ``weights`` by feature: the score of label 1 over 0."""
    weights: dict[str, float]
    step: np.ndarray      # [before, after]
    start: np.ndarray

    def path_score(self, element: Element | None) -> float:
        """The weights of the features along a path, summed from the nearest element whose sum is known."""
        chain, get = [], self.weights.get
        while element is not None and element.score is None:
            chain.append(element)
            element = element.parent
        total = element.score if element is not None else 0.0
        for e in reversed(chain):
            total += sum(get(x, 0.0) for x in e.new)
            e.score = total
        return total

    def scores(self, blocks: list[Block]) -> list[float]:
        out, get, inner = [], self.weights.get, {}
        for b in blocks:
            found = b.at.found if b.at else frozenset()
            if found not in inner:
                inner[found] = sum(get("in:" + x, 0.0) for x in sorted(found))
            out.append(self.path_score(b.at) + inner[found] + sum(get(x, 0.0) for x in sorted(text_features(b))))
        return out

    def decode(self, scores: list[float]) -> list[int]:
        """The most likely labels (Viterbi); of equal ones main text is preferred."""
        if not scores:
            return []
        (t00, t01), (t10, t11) = self.step.tolist()
        no, yes, back = self.start[0], self.start[1] + scores[0], []
        for s in scores[1:]:
            a, b = no + t00, yes + t10
            c, d = no + t01, yes + t11
            back.append((int(b >= a), int(d >= c)))
            no, yes = max(a, b), max(c, d) + s
        label, out = int(yes >= no), []
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return (out + [label])[::-1]


def _normalised(scores: np.ndarray, sizes: np.ndarray, step: np.ndarray, start: np.ndarray):
    """Forward-backward over padded pages (pages, blocks): the probability of label 1 of
    each block, the expected steps and starts."""
    pages, most = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], axis=2)
    alpha, beta = np.zeros((pages, most, 2)), np.zeros((pages, most, 2))
    alpha[:, 0] = start + emit[:, 0]
    for t in range(1, most):
        alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + emit[:, t]
    inside = np.arange(most) < sizes[:, None]
    for t in range(most - 2, -1, -1):
        after = np.logaddexp.reduce(step + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where(inside[:, t + 1, None], after, 0)
    total = np.logaddexp.reduce(alpha[np.arange(pages), sizes - 1], axis=1)
    both = np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None]
    steps = np.zeros((2, 2))
    for t in range(most - 1):
        pair = alpha[:, t, :, None] + step + (emit[:, t + 1] + beta[:, t + 1])[:, None, :] - total[:, None, None]
        steps += (np.exp(pair) * inside[:, t + 1, None, None]).sum(axis=0)
    return both[:, :, 1], steps, both[:, 0].sum(axis=0)


def train(pages: Iterable[str], rounds: int = 120, rate: float = 0.2, decay: float = 2e-5) -> Field:
    """Fit a field to pages whose elements carry ``data-main`` (0 or 1; blocks without a
    mark count as 0). Runs on the driver: labelled pages are few."""
    parsed = [b for b in map(blocks_of, pages) if b]
    if not parsed:
        raise ValueError("no labelled blocks")
    names: dict[str, int] = {}
    sizes = np.array([len(x) for x in parsed])
    most = sizes.max()
    flat = [(p, t, b) for p, page in enumerate(parsed) for t, b in enumerate(page)]
    found = [sorted(path_features(b) | text_features(b)) for _, _, b in flat]
    table = np.zeros((len(flat), len({x for fs in found for x in fs})))
    for i, fs in enumerate(found):
        table[i, [names.setdefault(x, len(names)) for x in fs]] = 1
    page, place = np.array([x[0] for x in flat]), np.array([x[1] for x in flat])
    truth = np.array([float(b.mark == "1") for _, _, b in flat])
    label = np.zeros((len(parsed), most), dtype=int)
    label[page, place] = truth
    real_steps, real_start = np.zeros((2, 2)), np.bincount(label[:, 0], minlength=2).astype(float)
    for p, n in enumerate(sizes):
        np.add.at(real_steps, (label[p, :n - 1], label[p, 1:n]), 1)
    params = [np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for i in range(1, rounds + 1):
        scores = np.zeros((len(parsed), most))
        scores[page, place] = table @ params[0]
        main, steps, starts = _normalised(scores, sizes, params[1], params[2])
        grads = [table.T @ (main[page, place] - truth), steps - real_steps, starts - real_start]
        for p, g, m, v in zip(params, grads, first, second):
            g = g / len(flat) + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-9)
        params[2][:] = 0  # pages may begin with anything
    return Field({x: float(params[0][i]) for x, i in names.items()}, params[1], params[2])


def main_text(html: str, field: Field) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, main in zip(blocks, field.decode(field.scores(blocks))) if main)


def extract_text(pages: DataFrame, field: Field | None = None, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with a string column ``into``: the main text of each page's whole html.

    Null, empty and block-free pages have the empty text. Elements may nest to any depth: time and
    memory go with the size of the page. Rows are read one by one, so
    repeated rows get equal texts and an empty table stays empty. Other columns pass
    through (one named ``into`` is replaced). Without ``field`` one is trained on the
    generated pages of this package.
    """
    spark = pages.sparkSession
    with_package(spark)
    model = spark.sparkContext.broadcast(field or train(labelled_pages()))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pd.Series([main_text(x, model.value) for x in pages_], dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    extract = F.pandas_udf(run, "string").asNondeterministic()
    return pages.withColumn(into, extract(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))
