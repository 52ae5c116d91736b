"""Problem 8: evaluation texts leaking into training text, by a distributed positional inverted index.

1. Index: the corpus is cut into blocks of documents of about BLOCK characters; each block is one row with its terms (64-bit
   hashes of all its words, sorted) and, term by term, the list of their positions. It is written once, knows nothing of the
   test items and serves any number of item sets. It is partitioned by document: a list never leaves its block, so nothing
   but document frequencies is shuffled.
2. The document frequencies of the items' words over the whole corpus tell which words of each item are rare; only the
   terms and list lengths are read for them.
3. In each block the lists of the items' words are taken, the rare ones drive the search. A posting at document position p
   of a word at item position o lies on diagonal p - o.
   Phrase: any run of RUN item words holds the rarest word of one of the item's windows; from each of its postings the
   neighbouring positions on the same diagonal are compared, which gives the exact run.
   Proximity: an item of n words that keeps two thirds of them keeps at least SPARE of its n/3 + SPARE rarest ones. In a
   passage of at most n + n/3 + 2 words their diagonals lie within 2n/3 + 3 of each other, so lists are intersected in bands
   of that width; passages found so are compared by their longest common subsequence with the item, from every start.
Both look-ups are necessary conditions, so no match is lost.

The test items are a stated query set; they are taken in blocks of ITEM_BLOCK, so what is sent to the workers is bounded.
Words are the longest runs of letters and digits in lower case. Null or empty texts on either side match nothing; repeated
documents count each; items with equal texts count each; an item shorter than RUN words can only match by proximity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessella.common import staged

RUN = 12
SPARE = 4
ITEM_BLOCK = 5000
#: Characters of a block of the index; a longer document is a block of its own.
BLOCK = 4_000_000
INDEX = "doc_ids array<long>, starts array<int>, terms array<long>, docs array<int>, ends array<int>, places array<int>"

_WORDS = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def _hashed(word: str) -> int:
    return xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _block_row(ids: list[int], found: list[list[str]]) -> pa.RecordBatch:
    """One row of the index. Positions run through the block's documents, with RUN free places before each (starts); the
    lists of positions follow each other by term (ends), docs is each term's document frequency."""
    local = _Ids()
    sizes = np.array([len(f) for f in found], np.int64)
    word = np.fromiter((local[w] for f in found for w in f), np.int32, int(sizes.sum()))
    hashes = np.fromiter(map(_hashed, local), np.int64, len(local))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    starts = np.cumsum(sizes + RUN) - sizes
    doc = np.repeat(np.arange(len(found)), sizes)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[doc]
    by = np.argsort(rank[word], kind="stable")
    ends = np.cumsum(np.bincount(rank[word], minlength=len(order)))
    term, doc = rank[word][by], doc[by]
    first = np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])] if len(term) else np.zeros(0, bool)
    docs = np.bincount(term[first], minlength=len(order))
    i32, i64 = pa.list_(pa.int32()), pa.list_(pa.int64())
    cols = ((ids, i64), (starts, i32), (hashes[order], i64), (docs, i32), (ends, i32), (place[by], i32))
    return pa.RecordBatch.from_arrays([pa.array([np.asarray(c, np.int64 if t is i64 else np.int32)], t) for c, t in cols], names=["doc_ids", "starts", "terms", "docs", "ends", "places"])


def index(docs: DataFrame) -> DataFrame:
    """The index of a corpus (doc_id, text), a table in the shared folder; see above. Documents without words are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, chars = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ws = words(text)
                if ws:
                    ids.append(doc)
                    found.append(ws)
                    chars += len(text)
                if chars >= BLOCK:
                    yield _block_row(ids, found)
                    ids, found, chars = [], [], 0
        if ids:
            yield _block_row(ids, found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return staged(rows.mapInArrow(run, INDEX), "index")


class Lookup:
    """What is looked up for a block of items: by word, the item positions that drive the phrase and the proximity search."""

    def __init__(self, items: dict[int, np.ndarray], df: np.ndarray):
        self.items = items
        self.names = np.array(sorted(items), np.int64)
        self.sizes = np.array([len(items[i]) for i in self.names.tolist()], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate([items[i] for i in self.names.tolist()] or [np.zeros(0, np.int32)])
        self.need = np.zeros(len(self.names), np.int64)
        self.width = 2 * self.sizes // 3 + 3
        rows = []
        for k, i in enumerate(self.names.tolist()):
            seq = items[i]
            n = len(seq)
            rarity = np.lexsort((np.arange(n), df[seq]))  # rarest first, ties by position
            order = np.empty(n, np.int64)
            order[rarity] = np.arange(n)
            phrase = {s + int(np.argmin(order[s : s + RUN])) for s in range(n - RUN + 1)}
            m = min(n, n // 3 + SPARE)
            self.need[k] = max(1, m - n // 3)
            near = set(rarity[:m].tolist())
            rows += [(int(seq[o]), k, o, o in phrase, o in near) for o in phrase | near]
        rows.sort()
        self.term, self.item, self.o, self.phrase, self.near = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
        self.phrase, self.near = self.phrase.astype(bool), self.near.astype(bool)

    def hits(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posting, look-up) pairs with equal words."""
        lo, hi = np.searchsorted(self.term, term, "left"), np.searchsorted(self.term, term, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(term)), n)
        return which, lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _runs(dense: np.ndarray, at: np.ndarray, flat: np.ndarray, pos: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The length of the run of equal words through dense[at] and flat[pos], looked at up to RUN each way; item positions
    stay within first..end. dense has RUN places without a word around each document."""
    total = np.ones(len(at), np.int64)
    for way in (-1, 1):
        going = np.ones(len(at), bool)
        for j in range(1, RUN):
            q = pos + way * j
            going &= (q >= first) & (q < end)
            going &= dense[np.where(going, at + way * j, 0)] == flat[np.where(going, q, 0)]
            if not going.any():
                break
            total += going
    return total


def in_order(terms: np.ndarray, places: np.ndarray, where: dict[int, list[int]], n: int, need: int) -> bool:
    """Whether some passage of about the item's length has need of its n words in their order."""
    masks = {t: sum(1 << o for o in os) for t, os in where.items()}
    keep = [(p, masks[t]) for t, p in zip(terms.tolist(), places.tolist()) if t in masks]
    span, full = n + n // 3 + 2, (1 << n) - 1
    end = 0
    for i, (p, _) in enumerate(keep):
        end = max(end, i)
        while end < len(keep) and keep[end][0] < p + span:
            end += 1
        if end - i < need:
            continue
        v = full
        for _, m in keep[i:end]:
            u = v & m
            v = ((v + u) | (v - u)) & full
        if n - v.bit_count() >= need:
            return True
    return False


def _match(look: Lookup, starts: np.ndarray, last: int, term: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
    """(document, item) numbers of the matches in a block. starts: of its documents; term, place: the postings of the items'
    words in the order of their places."""
    doc = np.searchsorted(starts, place, "right") - 1
    which, k = look.hits(term)
    d, p = doc[which], place[which]
    dense = np.full(last + RUN + 1, -1, np.int32)
    dense[place] = term
    item, o = look.item[k], look.o[k]
    ph = look.phrase[k]
    di, pi, ki, oi = d[ph], p[ph], item[ph], o[ph]
    run = _runs(dense, pi, look.flat, look.starts[ki] + oi, look.starts[ki], look.starts[ki + 1])
    found = set(zip(di[run >= RUN].tolist(), ki[run >= RUN].tolist()))
    nr = look.near[k]
    dn, kn, on = d[nr], item[nr], o[nr]
    if not len(dn):
        return sorted(found)
    band = (p[nr] - on) // look.width[kn]
    band = np.concatenate([band, band + 1])
    dn, kn, on = np.tile(dn, 2), np.tile(kn, 2), np.tile(on, 2)
    low = band.min()
    bands, width = int(band.max() - low) + 1, int(look.sizes.max()) + 1
    pair = dn.astype(np.int64) * len(look.names) + kn
    pairs, pair = np.unique(pair, return_inverse=True)  # small numbers, so that the groups fit 64 bits
    group = pair * bands + (band - low)
    g, n = np.unique(np.unique(group * width + on) // width, return_counts=True)
    ok = n >= look.need[pairs[g // bands] % len(look.names)]
    wheres: dict[int, dict[int, list[int]]] = {}
    for x, b in zip(pairs[g[ok] // bands].tolist(), (g[ok] % bands + low).tolist()):
        i, j = divmod(x, len(look.names))
        if (i, j) in found:
            continue
        seq, w = look.items[int(look.names[j])], int(look.width[j])
        if j not in wheres:
            wheres[j] = {}
            for at, t in enumerate(seq.tolist()):
                wheres[j].setdefault(t, []).append(at)
        # the passage's other words lie within a band's width of these
        lo = max(int(starts[i]), (b - 2) * w)
        hi = min(int(starts[i + 1]) if i + 1 < len(starts) else last + 1, (b + 2) * w + len(seq))
        part = slice(*np.searchsorted(place, [lo, hi]))
        if in_order(term[part], place[part], wheres[j], len(seq), -(-2 * len(seq) // 3)):
            found.add((i, j))
    return sorted(found)


def _lists(row: dict, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The postings of the words with these (sorted) hashes in a block: their numbers and places, in the order of places."""
    at = np.searchsorted(row["terms"], hashes)
    there = np.flatnonzero(row["terms"][np.minimum(at, len(row["terms"]) - 1)] == hashes) if len(row["terms"]) else np.zeros(0, np.int64)
    to = row["ends"][at[there]].astype(np.int64)
    n = np.diff(np.r_[0, row["ends"]])[at[there]].astype(np.int64)
    which = np.repeat(to - n - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    place, term = row["places"][which], np.repeat(there, n)
    order = np.argsort(place, kind="stable")
    return term[order].astype(np.int32), place[order].astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].values.to_numpy() for n in batch.schema.names}


def _leaks_of(found: DataFrame, items: dict[int, list[str]]) -> DataFrame:
    spark = found.sparkSession
    by_hash = {_hashed(w): w for ws in items.values() for w in ws}
    hashes = np.array(sorted(by_hash), np.int64)
    number = {by_hash[h]: i for i, h in enumerate(hashes.tolist())}
    coded = {k: np.array([number[w] for w in ws], np.int32) for k, ws in items.items() if ws}
    asked = spark.sparkContext.broadcast(hashes)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.value), np.int64)
        for row in _rows(batches):
            at = np.searchsorted(row["terms"], asked.value)
            there = row["terms"][np.minimum(at, len(row["terms"]) - 1)] == asked.value
            total[there] += row["docs"][at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    counts = found.select("terms", "docs").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # at most the items' words
    df = np.zeros(len(hashes), np.int64)
    for r in counts:
        df[r["term"]] = r["df"]
    sent = spark.sparkContext.broadcast(Lookup(coded, df))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = sent.value
        for row in _rows(batches):
            term, place = _lists(row, asked.value)
            got = _match(look, row["starts"].astype(np.int64), int(place[-1]), term, place) if len(term) and len(look.term) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(row["doc_ids"][i]) for i, _ in got], pa.int64()), pa.array([int(look.names[j]) for _, j in got], pa.int64())], names=["doc_id", "item_id"])

    return found.select("doc_ids", "starts", "terms", "ends", "places").mapInArrow(match, "doc_id long, item_id long")


def leaks_in(found: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: one row per pair that leaks. found: an index."""
    ids = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id")
    parts, block = [], {}
    for row in ids.toLocalIterator():
        block[row["item_id"]] = words(row["text"])
        if len(block) >= ITEM_BLOCK:
            parts.append(_leaks_of(found, block))
            block = {}
    if block or not parts:
        parts.append(_leaks_of(found, block))
    return reduce(DataFrame.unionByName, parts).distinct()


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: one row per pair that leaks."""
    return leaks_in(index(docs), items)


def leaked_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Of every test item, in how many documents it has leaked."""
    n = pairs.groupBy("item_id").agg(F.count("*").alias("n"))
    return items.select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).cast("long").alias("n_documents"))
