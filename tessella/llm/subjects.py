"""Problem 9: the subjects of each document, from a seeded non-negative factorisation of the document-term matrix.

1. Terms (words; pairs of neighbouring characters in scripts without spaces) are counted over all documents. The
   vocabulary is the terms in at least MIN_SHARE of them; as a document has few different terms, this bounds its size
   whatever the corpus. Common terms stay: they may be a text with many copies; the background takes those of all texts.
2. Components: one per subject, anchored by the annotators' labels, and one (BACKGROUND) for what all texts share.
   A labelled document may use only its subjects' components and the background; all others may use all.
3. Alternating non-negative (Kullback-Leibler) updates: given the components, each document's mixture; given the mixtures,
   the components, summed over the whole corpus. PASSES rounds over all documents.
4. With the components fixed, each paragraph gets its mixture; a paragraph deals with a subject that leads clearly. A
   subject is a case if at least a third of the document's paragraphs that deal with something deal with it.

A paragraph is a line of running text: lines without a sentence's end, cut-off teasers and code are left out. Null and
empty texts have no subject; documents whose text has no clear paragraph have none; labels of other spellings are
brought to lower case, unknown and null ones ignored; with no usable label at all there are no anchors and no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.common import staged

MIN_SHARE = 2e-4
MIN_DOCS = 3
BACKGROUND = 1
PASSES = 2
INNER = 6
#: Share of a term's labelled documents from which a subject claims it.
PURE = 0.3
#: A paragraph deals with a subject that has this share of its subject weight, if it has at least MIN_TOPICAL such words.
LEAD = 0.5
MIN_TOPICAL = 2.0

_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_PLAIN = re.compile(r"[^\W\d_]{3,}").findall
_MIXED = re.compile(r"[぀-ヿ㐀-鿿가-힣]+|[^\W\d_぀-ヿ㐀-鿿가-힣]{3,}").findall
_END = re.compile(r"[.!?”\"»](?:\s|$)|[。！？]").search
_BREAKS = re.compile(r"[\n\r\u2028\x85]+").split
_CODE_SIGNS = ("{", "}", "<", ">", "()", "=", "::", "->", "return ")
_CODE_STARTS = ("def ", "class ", "import ", "return ", "#", "//")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
#: A text whose line breaks are lost is taken apart into sentences from so many on.
LOST = 6


def sentences(line: str) -> list[str]:
    return [s for s in _SENTENCES.split(line) if s]


def paragraphs(text: str | None) -> list[str]:
    """The lines of running text; the sentences where the text stands on one or two lines as its breaks are lost."""
    out = []
    for line in _BREAKS(text or ""):
        line = line.strip()
        size = len(line)
        if size < 40 and (size < 14 or not _WIDE.search(line)):
            continue
        if line[-1] not in ".。!?" and not _END(line):
            continue
        tail = line[-6:].rstrip(" »›]")
        if tail.endswith(("...", "…")) or sum(map(line.count, _CODE_SIGNS)) + line.startswith(_CODE_STARTS) > 1 + size // 120:
            continue
        out.append(line)
    if len(out) <= 2 and sum(len(sentences(x)) for x in out) >= LOST:
        return [s for x in out for s in sentences(x)]
    return out


#: Letters in lower case, all else to spaces, byte by byte.
_APART = bytes(c if c < 128 and chr(c).isalpha() else 32 for c in range(256)).lower()


def terms(text: str) -> list[str]:
    if text.isascii():  # the same as below by a table of bytes
        return [w for w in text.encode().translate(_APART).decode().split() if len(w) > 2]
    text = text.lower()
    if not _WIDE.search(text):
        return _PLAIN(text)
    out: list[str] = []
    for w in _MIXED(text):
        if w < "\u3040":
            out.append(w)
        else:
            out.extend(map("".join, zip(w, w[1:])) if len(w) > 1 else [w])
    return out


def vocabulary(docs: DataFrame) -> list[str]:
    """The terms in at least MIN_SHARE of the documents, which bounds their number; so they may come to the driver."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for pdf in parts:
            for text in pdf["text"]:
                seen.update({t for p in paragraphs(text) for t in terms(p)})
            if len(seen) > 300_000:
                yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})
                seen = Counter()
        yield pd.DataFrame({"term": list(seen), "n": list(seen.values())}, columns=["term", "n"]).astype({"term": object, "n": "int64"})

    n = docs.count()
    counted = docs.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    least = max(MIN_DOCS, MIN_SHARE * n)
    return [r[0] for r in counted.where(F.col("n") >= least).select("term").orderBy("term").collect()]


def encoded(docs: DataFrame, vocab: list[str]) -> DataFrame:
    """doc_id, ids (the vocabulary's terms of all paragraphs), sizes (how many of them each paragraph has)."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocab)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = sent.value.get
        for pdf in parts:
            ids, sizes = [], []
            for text in pdf["text"]:
                each = [[i for i in map(get, terms(p)) if i is not None] for p in paragraphs(text)]
                ids.append(np.array([i for e in each for i in e], np.int32))
                sizes.append(np.array([len(e) for e in each], np.int32))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "ids": ids, "sizes": sizes})

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, ids array<int>, sizes array<int>")


def mixtures(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, n: int, comp: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Of n rows of a sparse matrix, the weights of the components (rows of W: comp), by multiplicative updates."""
    k = comp.shape[1]
    h = np.ones((n, k), np.float32) if allowed is None else allowed.astype(np.float32)
    w = comp[cols]
    starts = np.flatnonzero(np.r_[True, np.diff(rows) > 0]) if len(rows) else np.zeros(0, np.int64)
    for _ in range(INNER):
        ratio = counts / (np.einsum("ij,ij->i", w, h[rows]) + 1e-12)
        step = np.zeros_like(h)
        if len(starts):
            step[rows[starts]] = np.add.reduceat(w * ratio[:, None], starts, axis=0)
        h *= step
    return h


def _bags(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and counts of the sparse matrix whose rows hold the given terms."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    key = np.repeat(np.arange(len(ids)), sizes) << 32 | np.concatenate(ids).astype(np.int64)
    key, counts = np.unique(key, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, counts.astype(np.float32)


def seeds(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """doc_id, mask: bit s is set if a label names subject s; 0 for documents labelled as none."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s, 1 << i)]) if subjects else None
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim(F.lower("subject")).alias("s")).where("doc_id is not null and s is not null")
    bit = F.when(F.col("s") == "none", F.lit(0))
    if place is not None:
        bit = F.coalesce(bit, F.try_element_at(place, F.col("s")))
    return clean.select("doc_id", bit.alias("bit")).where("bit is not null").groupBy("doc_id").agg(F.bit_or("bit").cast("long").alias("mask"))


def _allowed(mask: np.ndarray, k: int) -> np.ndarray:
    """Which components a document may use: all if it has no label (-1), else its subjects and the background."""
    out = np.ones((len(mask), k + BACKGROUND), np.float32)
    for s in range(k):
        out[:, s] = np.where((mask < 0) | ((mask >> s) & 1 == 1), 1.0, 0.0)
    return out


def anchors(by_subject: np.ndarray, none: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The first W: a subject has the terms by how much of their labelled documents are its own beyond PURE, the
    background what no subject claims. by_subject: labelled documents with the term per subject; none: those without
    subject; base: how often the term occurs in the whole corpus."""
    prior = by_subject.sum(0) / max(by_subject.sum(), 1e-9)
    own = (by_subject + 2 * prior) / (by_subject.sum(1) + none + 2)[:, None]
    claim = np.clip((own - PURE) / (1 - PURE), 0, 1)
    rest = np.clip(1 - claim.sum(1), 0.02, 1) ** 2
    return _scaled(np.concatenate([base[:, None] * claim, (base * rest)[:, None]], axis=1))


def _scaled(w: np.ndarray) -> np.ndarray:
    """Columns that sum to one, without exact zeros."""
    return ((w + 1e-9) / (w + 1e-9).sum(0)).astype(np.float32)


def _summed(rows: DataFrame, step, n_terms: int, names: list[str]) -> np.ndarray:
    """n_terms x names: what step's matrices add up to over all parts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_terms, len(names)), np.float64)
        for pdf in parts:
            cols, add = step(list(pdf["ids"]), pdf["mask"].to_numpy())
            for c in range(len(names)):
                total[:, c] += np.bincount(cols, weights=add[:, c], minlength=n_terms)
        used = np.flatnonzero(total.sum(1))
        yield pd.DataFrame({"term": used} | {x: total[used, i] for i, x in enumerate(names)})

    sums = rows.mapInPandas(run, "term long, " + ", ".join(f"{x} double" for x in names)).groupBy("term").agg(*[F.sum(x).alias(x) for x in names]).toPandas()  # bounded by the vocabulary
    out = np.zeros((n_terms, len(names)))
    out[sums["term"].to_numpy()] = sums[names].to_numpy()
    return out


def components(coded: DataFrame, labels: DataFrame, n_terms: int, k: int) -> np.ndarray:
    """W: n_terms x (k + BACKGROUND), columns sum to one: the anchors, then PASSES alternating updates over all documents."""
    rows = staged(coded.join(labels, "doc_id", "left").select("ids", F.coalesce("mask", F.lit(-1)).cast("long").alias("mask")), "seeded")

    def count(ids: list[np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, cols, counts = _bags(ids)
        m = mask[at]
        own = [np.where((m >= 0) & ((m >> s) & 1 == 1), 1.0, 0.0) for s in range(k)]
        return cols, np.stack([*own, np.where(m == 0, 1.0, 0.0), counts], axis=1)

    first = _summed(rows, count, n_terms, [f"s{i}" for i in range(k)] + ["none", "base"])
    comp = anchors(first[:, :k], first[:, k], first[:, k + 1])
    for _ in range(PASSES):
        sent = coded.sparkSession.sparkContext.broadcast(comp)

        def update(ids: list[np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w = sent.value
            at, cols, counts = _bags(ids)
            h = mixtures(at, cols, counts, len(ids), w, _allowed(mask, k))
            r = w[cols] * h[at]
            r *= (counts / (r.sum(1) + 1e-12))[:, None]
            return cols, r

        comp = _scaled(_summed(rows, update, n_terms, [f"c{i}" for i in range(k + BACKGROUND)]))
    return comp


def subjects_of(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """doc_id, subject: one row per subject a document deals with."""
    names = [r[0] for r in areas.where("subject is not null").select("subject").distinct().orderBy("subject").collect()]  # the list of subject areas
    k = len(names)
    vocab = vocabulary(docs)
    coded = staged(encoded(docs, vocab), "encoded")
    marks = seeds(labels, names)
    if not k or not vocab or marks.where("mask > 0").isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("subject")).limit(0)
    comp = components(coded, marks, len(vocab), k)
    sent = docs.sparkSession.sparkContext.broadcast(comp)

    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for pdf in parts:
            ids, owner = [], []
            for i, (all_ids, sizes) in enumerate(zip(pdf["ids"], pdf["sizes"])):
                at = 0
                for s in sizes:
                    ids.append(np.asarray(all_ids[at : at + s]))
                    owner.append(i)
                    at += s
            owner = np.array(owner, np.int64)
            rows, cols, counts = _bags(ids)
            h = mixtures(rows, cols, counts, len(ids), w)
            on = h[:, :k]
            mass = on.sum(1)
            lead = on.argmax(1)
            clear = (mass >= MIN_TOPICAL) & (on.max(1) >= LEAD * mass)
            got = np.zeros((len(pdf), k))
            np.add.at(got, (owner[clear], lead[clear]), 1)
            total = got.sum(1)
            doc, sub = np.nonzero((got * 3 >= total[:, None]) & (got > 0))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[doc], "subject": np.array(names, object)[sub]})

    return coded.mapInPandas(decide, "doc_id long, subject string")
