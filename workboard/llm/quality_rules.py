"""Quality rules on repetition, by suffix arrays with longest common prefixes.

A text is a sequence of words. Its suffix array (prefix doubling in numpy; only
suffixes that still tie are sorted again) puts equal beginnings side by side. The
longest common prefixes (LCP) of neighbours form LCP intervals: an interval of value
l is a substring of l words that stands at each of the interval's suffixes and can't
be extended to the right at all of them; it is a maximal repeat if it can't be
extended to the left either. The union of the maximal repeats' spans gives the
covered share of the text; the deepest interval above a suffix has the longest repeat
that starts there, so the union needs one span for each suffix.

A text is kept if the base rules hold (``min_words``, repeated three-word windows),
maximal repeats of ``min_repeat`` or more words cover at most ``max_covered`` of its
words, and none is longer than ``max_longest`` of its words and ``longest_floor`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import free_name, text_bytes, with_package


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_window_percent: int = 50
    min_repeat: int = 8
    max_covered: float = 0.5
    max_longest: float = 0.2  # below half of max_covered, as a repeat that stands twice covers twice its words
    longest_floor: int = 100


#: Texts are put into one suffix array up to so many words; a longer text has its own.
CHUNK_WORDS = 1 << 17
_NOT_FIRST_BYTE = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def suffix_array(tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP with the previous suffix) of tokens; suffixes end with their
    document, and those of different documents have no common prefix.

    ``doc`` ascends. Ranks are kept for each doubling level, and an LCP is read off
    them from the largest level down.
    """
    n = len(tokens)
    first = doc.astype(np.int64) * (int(tokens.max(initial=0)) + 1) + tokens
    order = np.argsort(first, kind="stable")
    new = np.r_[True, np.diff(first[order]) != 0]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels = [rank]
    group = np.bincount(rank[:n], minlength=n)
    live = np.flatnonzero(group[rank[:n]] > 1)
    step = 1
    while len(live):
        rank = rank.copy()
        follow = rank[np.minimum(live + step, n)]
        ends = np.minimum(live + step, n)
        same = (ends < n) & (doc[np.minimum(ends, n - 1)] == doc[live])
        follow = np.where(same, follow, -1)
        by = np.lexsort((follow, rank[live]))
        live, old, follow = live[by], rank[live][by], follow[by]
        head = np.r_[True, old[1:] != old[:-1]]
        new = head | np.r_[True, follow[1:] != follow[:-1]]
        place = np.arange(len(live))
        rank[live] = old + place[new][np.cumsum(new) - 1] - place[head][np.cumsum(head) - 1]
        levels.append(rank)
        group = np.bincount(np.cumsum(new) - 1)
        live = np.sort(live[(group > 1)[np.cumsum(new) - 1]])
        step *= 2
    sa = np.empty(n, dtype=np.int64)
    sa[rank[:n]] = np.arange(n)
    lcp = np.zeros(n, dtype=np.int64)
    open_ = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, total = sa[open_ - 1].copy(), sa[open_].copy(), np.zeros(len(open_), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) & (a < n) & (b < n)
        jump = same * (1 << k)
        total, a, b = total + jump, np.minimum(a + jump, n), np.minimum(b + jump, n)
    lcp[open_] = total
    return sa, lcp


def longest_repeats(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position the words of the longest substring that starts there and
    stands elsewhere too: the value of the deepest LCP interval above its suffix."""
    out = np.zeros(len(sa), dtype=np.int64)
    out[sa] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return out


def covered(lengths: np.ndarray) -> np.ndarray:
    """Marks the union of the spans [p, p + lengths[p])."""
    if not len(lengths):
        return np.zeros(0, dtype=bool)
    reach = np.maximum.accumulate(np.arange(len(lengths)) + lengths)
    return reach > np.arange(len(lengths))


def maximal_repeats(tokens: np.ndarray, doc: np.ndarray, sa: np.ndarray, lcp: np.ndarray,
                    least: int) -> list[tuple[int, int, int]]:
    """(a start, words, number of places) of each maximal repeat of ``least`` or more words."""
    before = np.where((sa > 0) & (doc[np.maximum(sa - 1, 0)] == doc[sa]), tokens[np.maximum(sa - 1, 0)], -1 - sa)
    turns = np.r_[0, np.cumsum(before[1:] != before[:-1])]
    out = []
    edges = np.flatnonzero(np.diff(np.r_[0, (lcp >= least).astype(np.int8), 0]))
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
        stack: list[tuple[int, int]] = []  # (LCP value, left end)
        for i in range(low, high + 1):
            value, left = (int(lcp[i]) if i < high else 0), i - 1
            while stack and stack[-1][0] > value:
                size, left = stack.pop()
                if turns[i - 1] != turns[left]:
                    out.append((int(sa[left]), size, i - left))
            if i < high and (not stack or stack[-1][0] < value):
                stack.append((value, left))
    return out


_RESULT = T.StructType([T.StructField(x, T.LongType()) for x in
                        ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                       + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
                       + [T.StructField(x, T.LongType()) for x in ("n_maximal_repeats", "n_covered", "longest_repeat")])


def _chunk(texts: list[bytes], words: list[list[bytes]], rules: Rules) -> pd.DataFrame:
    sizes = np.array([len(x) for x in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    numbers: dict[bytes, int] = {}
    tokens = np.array([numbers.setdefault(w, len(numbers)) for x in words for w in x], dtype=np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    if len(tokens):
        sa, lcp = suffix_array(tokens, doc)
        longest = longest_repeats(sa, lcp)
        found = maximal_repeats(tokens, doc, sa, lcp, rules.min_repeat)
    else:
        longest, found = np.zeros(0, dtype=np.int64), []

    def each(values):
        sums = np.r_[0, np.cumsum(values, dtype=np.int64)]
        return sums[ends] - sums[starts]

    n_covered = each(covered(np.where(longest >= rules.min_repeat, longest, 0)))
    most = np.zeros(len(words), dtype=np.int64)
    np.maximum.at(most, doc, longest)
    repeats = np.zeros(len(words), dtype=np.int64)
    if found:
        np.add.at(repeats, doc[[x[0] for x in found]], 1)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    out = pd.DataFrame({
        "n_words": sizes,
        "word_chars": [len(b"".join(x).translate(None, _NOT_FIRST_BYTE)) for x in words],
        "n_symbols": [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": each(covered(np.where(longest >= 3, 3, 0)))})
    out["base_failed"] = (sizes < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_window_percent * sizes)
    out["kept"] = (~out["base_failed"] & (n_covered <= rules.max_covered * sizes)
                   & ((most <= rules.max_longest * sizes) | (most <= rules.longest_floor)))
    return out.assign(n_maximal_repeats=repeats, n_covered=n_covered, longest_repeat=most)


def measure(texts: pd.Series, rules: Rules = Rules()) -> pd.DataFrame:
    """A row of measures for each text (UTF-8 bytes)."""
    parts, part, words, size = [], [], [], 0
    for text in texts:
        found = text.split()  # bytes split at ASCII white space only
        if part and size + len(found) > CHUNK_WORDS:
            parts.append(_chunk(part, words, rules))
            part, words, size = [], [], 0
        part.append(text)
        words.append(found)
        size += len(found)
    if part:
        parts.append(_chunk(part, words, rules))
    return pd.concat(parts, ignore_index=True) if parts else _chunk([], [], rules)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into`` of the measures and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; null counts as empty, has no
    words and isn't kept. Rows are judged one by one: repeated rows get equal results
    and an empty table gives an empty table. Other columns pass through.
    """
    with_package(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield measure(texts, rules)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    judged = F.pandas_udf(run, _RESULT).asNondeterministic()
    return docs.withColumn(into, judged(text_bytes(text_col)))


def drop_low_quality(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    name = free_name(docs, "quality")
    return quality_rules(docs, rules, text_col, name).where(F.col(name)["kept"]).select(*docs.columns)
