"""Problem 2: keyword-stuffed and link-list pages, by the pointwise mutual information of neighbouring words.

1. Over the whole corpus: on how many pages each word, and each pair of neighbouring words, occurs (features). Nothing is
   cut off: a pair of one page alone has the count 1. Counts come back to the shards that need them, never to the driver.
2. PMI of a pair: log(pages * n(xy) / (n(x) n(y))). Of the running part of each page (furniture, heading and byline aside,
   see layout): the mean PMI, the share of incoherent pairs (PMI below COHERENT), the share of repeats among collocations
   (PMI above 0), plain and weighted by PMI, the share of the commonest words, and how much of it stands in sentences.
3. A page is a case
   - if collocations are repeated excessively: the weighted share of repeats and that of the commonest words are both beyond
     what pages in sentences show (WEIGHTED, COMMON);
   - or if hardly anything stands in sentences (PROSE; tables aside) and the pairs are not those of text: word salad (many
     incoherent pairs), repeated collocations, or nothing but collocations (mean PMI far above that of text, CLOSED).

Null, empty and blank contents are no cases; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.llm import layout

#: Limits, the same at every size of the corpus. WEIGHTED and COMMON lie at the upper fences (third quartile and 1.5 times
#: the quartiles' distance) that pages have on sf0.1.
PAIRS = 40
WEIGHTED, COMMON = 0.55, 0.38
PROSE, PAIRS_LOOSE = 0.2, 60
COHERENT, INCOHERENT = 1.5, 0.2
REPEATED, CLOSED = 0.08, 4.0
#: How many of a page's words are its commonest.
TOP = 8

STATISTICS = "pairs long, pmi double, incoherent double, repeated double, weighted double, common double, prose double"


def _pmi(pair: np.ndarray, known: tuple[np.ndarray, np.ndarray], pages: int) -> np.ndarray:
    """Of pairs (first << 32 | second); known: the words and pairs that occur on more than one page, and on how many."""
    order = np.argsort(known[0])
    key, n = known[0][order], known[1][order].astype(np.float64)

    def count(x: np.ndarray) -> np.ndarray:
        if not len(key):
            return np.ones(len(x))
        at = np.minimum(np.searchsorted(key, x), len(key) - 1)
        return np.where(key[at] == x, n[at], 1.0)

    return np.log(max(pages, 1) * count(pair) / (count(pair >> 32) * count(pair & 0xFFFFFFFF)))


def _ranks(group: np.ndarray) -> np.ndarray:
    """Numbers within runs of equal values."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))


def statistics(word: np.ndarray, n_words: np.ndarray, n_lines: np.ndarray, label: np.ndarray, look: np.ndarray, size: np.ndarray, known: tuple[np.ndarray, np.ndarray], pages: int) -> dict[str, pa.Array]:
    """STATISTICS of a shard's pages. word: their words one after the other, 0 for the end of a line; label, look, size: of
    their lines; pages: of the whole corpus."""
    n = len(n_words)
    page, line_page = np.repeat(np.arange(n), n_words), np.repeat(np.arange(n), n_lines)
    running = ((label == layout.L_TEXT) | (label == layout.L_LIST)) & (look & layout.TRACE == 0)
    line = np.cumsum(word == 0) - (word == 0) + page
    on = running[line] if len(line) else np.zeros(0, bool)

    def per_page(of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, weights=weights, minlength=n)

    at = np.flatnonzero(word > 0)
    a, b = at[:-1], at[1:]
    ok = (page[a] == page[b]) & on[a] & on[b]
    a, b = a[ok], b[ok]
    of = page[a].astype(np.int64)
    each, which = np.unique(word[a] << 32 | word[b], return_inverse=True)
    pmi = _pmi(each, known, pages)
    m = per_page(of)
    some = np.maximum(m, 1)
    in_page, times = np.unique(of * max(1, len(each)) + which, return_counts=True)
    its, pair = in_page // max(1, len(each)), in_page % max(1, len(each))
    again = np.where(pmi[pair] > 0, times - 1, 0)
    used = at[on[at]]
    words, counts = np.unique(page[used].astype(np.int64) << 32 | word[used], return_counts=True)
    order = np.lexsort((-counts, words >> 32))
    whose, counts = (words >> 32)[order], counts[order]
    top = _ranks(whose) < TOP
    told = running & (look & layout.TABLE == 0)
    sentences = told & (look & layout.SENT > 0)
    return {
        "pairs": pa.array(m, pa.int64()),
        "pmi": pa.array(per_page(of, pmi[which]) / some),
        "incoherent": pa.array(per_page(of, (pmi[which] < COHERENT).astype(float)) / some),
        "repeated": pa.array(per_page(its, again.astype(float)) / some),
        "weighted": pa.array(per_page(its, again * pmi[pair]) / np.maximum(per_page(its, times * np.abs(pmi[pair])), 1e-9)),
        "common": pa.array(per_page(whose[top], counts[top].astype(float)) / np.maximum(per_page(page[used]), 1)),
        "prose": pa.array(per_page(line_page, np.where(sentences, size, 0)) / np.maximum(per_page(line_page, np.where(told, size, 0)), 1)),
    }


def is_stuffed() -> Column:
    """Collocations are repeated excessively; of the columns STATISTICS."""
    return (F.col("pairs") >= PAIRS) & (F.col("weighted") >= WEIGHTED) & (F.col("common") >= COMMON)


def is_loose() -> Column:
    """Entries, tags, addresses or word salad rather than sentences; of the columns STATISTICS."""
    c = F.col
    return (c("pairs") >= PAIRS_LOOSE) & (c("prose") < PROSE) & ((c("incoherent") >= INCOHERENT) | (c("repeated") >= REPEATED) | (c("pmi") >= CLOSED))


def is_spam() -> Column:
    return is_stuffed() | is_loose()
