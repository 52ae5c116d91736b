"""Problem 7: a whole corpus under a byte-level BPE vocabulary, by replaying the merges over blocks of the corpus.

Each task takes its part of the corpus in blocks (Arrow batches). Of a block, the different words not met before are laid
end to end; an inverted index from token pair to word positions is built for all of them at once, and the merges that
occur are applied in rank order, each at all of its positions, after which only the touched neighbours are put into the
index. A merge never makes a pair of lower rank than its own, so one pass in rank order is complete. The words' ids are
kept for later blocks (at most KEEP_WORDS of them) and the documents put together from them. There is no shuffle.

Null and empty texts give an empty list; blank text is encoded; special tokens' strings are plain text. The vocabulary
file is read on the driver and sent to the workers (at most 65,536 ids).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern of the vocabulary's own description that cuts a text into words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEEP_WORDS = 400_000


def _byte_letters() -> dict[int, str]:
    """How the vocabulary file spells each byte: printable Latin-1 as itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def load_merges(path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(the id of each byte, rows left id, right id, merged id in rank order)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    spelled = _byte_letters()
    return np.array([vocab[spelled[b]] for b in range(256)], np.int32), np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)


class MergeReplay:
    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        self.byte_ids = byte_ids
        keys = merges[:, 0].astype(np.int64) << 16 | merges[:, 1]
        order = np.argsort(keys)
        self.sorted_keys, self.sorted_ranks = keys[order], order
        self.rank = dict(zip(keys.tolist(), range(len(keys))))
        self.table = merges.tolist()

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of an int32 array. Words are not empty."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        first = self.byte_ids[raw]
        n = len(first)
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[ends - lengths] = -1
        left = np.flatnonzero(nxt >= 0)
        keys = first[left].astype(np.int64) << 16 | first[left + 1]
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        known = self.sorted_keys[at] == keys
        ranks, spots = self.sorted_ranks[at[known]], left[known]
        order = np.argsort(ranks, kind="stable")
        ranks, spots = ranks[order], spots[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        index = {int(r[0]): s.tolist() for r, s in zip(np.split(ranks, cuts), np.split(spots, cuts)) if len(r)}
        heap = list(index)
        heapify(heap)
        sym, nxt, prv, rank, table = first.tolist(), nxt.tolist(), prv.tolist(), self.rank.get, self.table
        while heap:
            r = heappop(heap)
            a, b, m = table[r]
            where = index.pop(r)
            if a == b:
                where.sort()
            for p in where:
                q = nxt[p]
                if q < 0 or sym[p] != a or sym[q] != b:
                    continue
                sym[p], sym[q] = m, -1
                n2 = nxt[p] = nxt[q]
                if n2 >= 0:
                    prv[n2] = p
                    k = rank(m << 16 | sym[n2])
                    if k is not None:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            heappush(heap, k)
                p2 = prv[p]
                if p2 >= 0:
                    k = rank(sym[p2] << 16 | m)
                    if k is not None:
                        if k in index:
                            index[k].append(p2)
                        else:
                            index[k] = [p2]
                            heappush(heap, k)
        done = np.array(sym, np.int32)
        kept = done >= 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        packed = done[kept].tobytes()
        start, stop = (upto[ends - lengths] * 4).tolist(), (upto[ends] * 4).tolist()
        return [packed[s:e] for s, e in zip(start, stop)]


#: Where a space stands beside other white space; elsewhere a text can be taken apart at its spaces.
_BESIDE = re.compile(r" [\s\x85]|[\s\x85] ")


def encode_blocks(batches: Iterable[pa.RecordBatch], byte_ids: np.ndarray, merges: np.ndarray, id_column: str, text_column: str) -> Iterator[pa.RecordBatch]:
    """No word of the pattern goes on past a single space between other characters, and such a space opens the next word.
    So a text without other spaces is the row of its space-separated chunks, which are cut into words once each."""
    import regex

    cut = regex.compile(PATTERN).findall
    replay = MergeReplay(byte_ids, merges)
    words: dict[str, bytes] = {}
    chunks: dict[str, bytes] = {}  # ids of ' ' + chunk
    for batch in batches:
        texts = batch.column(text_column).to_pylist()
        if len(words) + len(chunks) > KEEP_WORDS:
            words, chunks = {}, {}
        heads, tails = [], []
        for t in texts:
            if not t:
                heads.append(())
                tails.append(())
            elif t[0] == " " or t[-1] == " " or _BESIDE.search(t):
                heads.append(cut(t))
                tails.append(())
            else:
                first, *rest = t.split(" ")
                heads.append(cut(first))
                tails.append(rest)
        new_chunks = [*{c for tail in tails for c in tail if c not in chunks}]
        new_pieces = [cut(" " + c) for c in new_chunks]
        new = [*{w for ws in heads for w in ws if w not in words}.union(w for ws in new_pieces for w in ws if w not in words)]
        if new:
            words.update(zip(new, replay.encode([w.encode("utf-8", "replace") for w in new])))
        get = words.__getitem__
        chunks.update((c, b"".join(map(get, ws))) for c, ws in zip(new_chunks, new_pieces))
        of = chunks.__getitem__
        packed = [b"".join(map(get, h)) + b"".join(map(of, t)) for h, t in zip(heads, tails)]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(id_column), ids], names=[id_column, "ids"])


def encode_corpus(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id_column and ids (array<int>), one row per row of docs."""
    byte_ids, merges = load_merges(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((byte_ids, merges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encode_blocks(batches, *sent.value, id_column, text_column)

    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} long, ids array<int>")
