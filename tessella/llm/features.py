"""One pass over the pages: what the operators of problems 2, 4 and 6 need of each, without its text.

The pass writes one table (staged, so it is read many times but computed once) with two kinds of rows, in shards of about
SHARD characters of text. A shard never crosses a task, so its number is that of the task and a running one.

- Of each page: per line its unit, opener, look and size, and its words under the shard's own numbers.
- Of each shard: its units (with url, host and where they stand; once more without url), and its words and pairs of
  neighbouring words (number in the shard, 64-bit hash, in how many of its pages).

'far' of a page are the leaves of problem 6 of its long segments that by their words are no messages, and their lines;
'hit_at' are the lines of its segments that are. Which lines may say a message is told for a whole batch at once.

Units are negative numbers, hashed together with their host; numbers of words and pairs are positive.

Counts over the corpus are sums over shards in Spark; what a shard needs of them is joined by its own keys and comes back
with the shard's pages as one group, whose size SHARD bounds. No host, word or pair is gathered in one task. A single text
longer than SHARD is a shard of its own.
"""

from __future__ import annotations

import functools
import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from xxhash import xxh64_intdigest

from tessella.common import host_of, not_blank, staged
from tessella.llm import layout, residue

SHARD = 20_000_000

#: Words; each sign of scripts without spaces is one. A line's end is a token of its own.
_WORDS = re.compile(r"\n|[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+").findall
_APART = bytes(c if chr(c).isalnum() or c == 1 else 32 for c in range(128)) + bytes(range(128, 256))


_ODD = re.compile(r"[^\x00-\x7f]").findall


def words(low: str) -> list[str]:
    """The words of a text in lower case."""
    if "\x01" in low:
        return _WORDS(low)
    if not low.isascii():
        for c in set(_ODD(low)):
            if "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff":
                return _WORDS(low)
            if not c.isalnum():
                low = low.replace(c, " ")
    # the same by a table of bytes
    return low.replace("\n", " \x01 ").encode().translate(_APART).decode().split()


SCHEMA = """shard long, result_id long, host long, url long, unit array<long>, open array<long>, look array<int>, size array<int>, word array<int>,
far array<long>, far_at array<int>, hit_at array<int>,
u_unit array<long>, u_url array<long>, u_host array<long>, u_flags array<int>, own array<long>, w_local array<long>, w_key array<long>, w_n array<int>"""
_I64, _I32 = pa.list_(pa.int64()), pa.list_(pa.int32())
_ARROW = pa.schema(
    [(n, pa.int64()) for n in "shard result_id host url".split()]
    + [(n, t) for n, t in zip("unit open look size word far far_at hit_at".split(), (_I64, _I64, _I32, _I32, _I32, _I64, _I32, _I32))]
    + [(n, t) for n, t in zip("u_unit u_url u_host u_flags own w_local w_key w_n".split(), (_I64, _I64, _I64, _I32, _I64, _I64, _I64, _I32))]
)
#: What is kept of each line, and its type.
_OF_LINE = {"unit": "q", "open": "q", "look": "i", "size": "i"}
_LOWEST = -0x8000000000000000
#: Bits of u_flags: the unit is an opener; COUNTS of layout.
IS_OPENER, OPENS, BYLINE, ALONE, WHOLE = 1, 2, 4, 8, 16
#: Bits of may_say.
SAYS, LOREM, SLOT = 1, 2, 4
#: Entries of one row of a shard's units or words.
CHUNK = 200_000
#: Rows of a batch of pages.
PAGES = 2000


def _hash(text: str) -> int:
    """63 bits, never 0."""
    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 or 1


class Lines(dict):
    """line -> (look, hash of its letters, hash of its opener, size, separator); template lines come again and again."""

    def __init__(self):
        self.leaves, self.told = Leaves(), Told()

    def __missing__(self, line: str) -> tuple[int, int, int, int, str]:
        if len(self) > 100_000:
            self.clear()
        look, key, opener, sep = layout.look_of(line)
        if len(line) > residue.LONG:
            look |= min(3, residue.long_segments(line)) * layout.LONG
        found = self[line] = (look, _hash(key) if key else 0, _hash("opener " + opener) if opener else 0, len(line.strip()), sep)
        return found


def leaf_of(segment: str) -> int:
    return _hash("leaf " + residue.coarse_leaf(segment)) | _LOWEST


class Leaves(dict):
    """line without messages -> hashed leaves of its long segments; leaves are negative as units are."""

    def __missing__(self, line: str) -> list[int]:
        if len(self) > 2000:
            self.clear()
        found = self[line] = [leaf_of(x) for x in residue.segments(line) if len(x) > residue.LONG]
        return found


class Told(dict):
    """line that may say a message -> (how many of its segments do, leaves of its other long ones)."""

    def fill(self, lines: list[str]) -> None:
        if len(self) > 20_000:
            self.clear()
        lines = [x for x in lines if x not in self]
        each = [residue.segments(x) for x in lines]
        said = iter(residue.said([x for xs in each for x in xs]))
        for line, xs in zip(lines, each):
            other = [x for x in xs if not next(said)]
            self[line] = len(xs) - len(other), [leaf_of(x) for x in other if len(x) > residue.LONG]


class Local(dict):
    """word -> its number in the shard, from 1; 0 is the end of a line."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) - 1
        return n


class Shard:
    def __init__(self, number: int):
        self.number, self.chars, self.ids = number, 0, Local({"\n": 0, "\x01": 0})
        self.pages: list[tuple[int | None, int | None, int | None]] = []
        self.of_line = {n: array(c) for n, c in _OF_LINE.items()}
        self.of_word, self.n_lines, self.n_words = array("i"), array("i"), array("i")
        self.units: dict[tuple[int, int], int] = {}
        self.own: dict[int, int] = {}
        self.far, self.far_at, self.n_far, self.hit_at, self.n_hits = array("q"), array("i"), array("i"), array("i"), array("i")

    def add(self, lines: Lines, rid: int | None, host: int | None, url: int | None, title: str | None, content: str, may: list[int] | None = None) -> None:
        """may: of each line (may_say); without it nothing is looked for that problem 6 needs."""
        texts = content.split("\n")
        look, unit, open_, size, sep = map(list, zip(*map(lines.__getitem__, texts)))
        core = layout.title_core(title)
        if core:
            key = _hash(core)
            look = [x | layout.TITLE if u == key else x for x, u in zip(look, unit)]
        if may is not None and max(may) > SAYS:
            look = [x | (layout.SLOT if m & SLOT and residue.has_slot(t) else 0) | (layout.FILLER if m & LOREM and residue.is_lorem(t) else 0) for x, t, m in zip(look, texts, may)]
        self._far(lines, texts, look, may) if may is not None else self._none()
        salt = 0 if host is None else (host & 0x7FFFFFFFFFFFFFFF) * 0x5851F42D4C957F2D & 0x7FFFFFFFFFFFFFFF
        unit = [u ^ salt | _LOWEST if u else 0 for u in unit]
        open_ = [u ^ salt | _LOWEST if u else 0 for u in open_]
        before = len(self.of_word)
        self.of_word.extend(map(self.ids.__getitem__, words(content.lower())))
        self.n_words.append(len(self.of_word) - before)
        for values, found in zip(self.of_line.values(), (unit, open_, look, size)):
            values.extend(found)
        self.n_lines.append(len(texts))
        self.pages.append((rid, host, url))
        self.chars += len(content)
        if url is not None:
            self._places(host, url, [i for i, x in enumerate(look) if not x & layout.BLANK], look, unit, open_, size, sep)

    def _far(self, lines: Lines, texts: list[str], look: list[int], may: list[int]) -> None:
        far, hits = len(self.far), len(self.hit_at)
        for i, x in enumerate(look):
            if x & layout.FILLER:
                self.hit_at.append(i)
                continue
            if may[i] & SAYS:
                n, found = lines.told[texts[i]]
                self.hit_at.extend([i] * n)
            elif x >= layout.LONG:
                found = lines.leaves[texts[i]]
            else:
                continue
            self.far.extend(found)
            self.far_at.extend([i] * len(found))
        self.n_far.append(len(self.far) - far)
        self.n_hits.append(len(self.hit_at) - hits)

    def _none(self) -> None:
        self.n_far.append(0)
        self.n_hits.append(0)

    def _places(self, host: int, url: int, at: list[int], look: list[int], unit: list[int], open_: list[int], size: list[int], sep: list[str]) -> None:
        units, own, item, sent = self.units, self.own, layout.ITEM, layout.SENT
        last, texts = len(at) - 1, 0
        for j, i in enumerate(at):
            texts += layout.is_text(look[i], size[i])
            if not unit[i]:
                continue
            before, after = (look[at[j - 1]] if j else -1), (look[at[j + 1]] if j < last else -1)
            flags = 0
            if after >= 0 and (after & item or not after & sent and any(look[k] & item for k in at[j + 2 : j + 4])):
                flags |= OPENS
            if before >= 0 and after >= 0 and texts < 2 and not before & (sent | item) and after & sent and not after & item and not look[i] & (sent | item):
                flags |= BYLINE
            k = (unit[i], url)
            units[k] = units.get(k, 0) | flags
            own[unit[i]] = host
            if open_[i]:
                # alone: no neighbour of the same build; whole: what follows the label is a sentence
                flags = IS_OPENER
                if not (j and sep[at[j - 1]] == sep[i] or j < last and sep[at[j + 1]] == sep[i]):
                    flags |= ALONE
                if look[i] & sent and not look[i] & layout.CUT:
                    flags |= WHOLE
                k = (open_[i], url)
                units[k] = units.get(k, 0) | flags
                own[open_[i]] = host

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """local, key, n of the words and pairs; local of a pair is first << 32 | second."""
        all_of = np.frombuffer(self.of_word, np.int32)
        word = all_of[all_of > 0].astype(np.int64)
        page = np.repeat(np.arange(len(self.pages), dtype=np.int64), np.frombuffer(self.n_words, np.int32))[all_of > 0]
        keys = np.zeros(len(self.ids), np.uint64)
        keys[list(self.ids.values())] = [xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.ids]
        same = page[1:] == page[:-1]  # the end of a line between two words does not part them
        bits = max(1, len(self.ids)).bit_length()
        n_pages = max(1, len(self.pages))

        def in_pages(code: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            shift = n_pages.bit_length()
            if 2 * bits + shift < 63:
                code = code << shift
                code |= of
                code.sort()
                new = code[1:] != code[:-1]
                code >>= shift
            else:
                order = np.lexsort((of, code))
                code, of = code[order], of[order]
                new = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
            code = code[np.r_[True, new]] if len(code) else code
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
            return code[first], np.diff(np.r_[first, len(code)])

        w, wn = in_pages(word, page)
        pair, pn = in_pages((word[:-1] << bits | word[1:])[same], page[1:][same])
        x, y = pair >> bits, pair & ((1 << bits) - 1)
        with np.errstate(over="ignore"):
            mixed = (keys[x] * np.uint64(0x9E3779B97F4A7C15) + keys[y]) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        return np.concatenate([w, x << 32 | y]), np.concatenate([keys[w], mixed]).view(np.int64), np.concatenate([wn, pn]).astype(np.int32)

    def rows(self) -> Iterator[pa.RecordBatch]:
        lists = {n: _lists(v, self.n_lines) for n, v in self.of_line.items()} | {"word": _lists(self.of_word, self.n_words), "far": _lists(self.far, self.n_far), "far_at": _lists(self.far_at, self.n_far), "hit_at": _lists(self.hit_at, self.n_hits)}
        for at in range(0, len(self.pages), PAGES):
            some = self.pages[at : at + PAGES]
            ids = {n: pa.array([p[i] for p in some], pa.int64()) for i, n in enumerate(("result_id", "host", "url"))}
            yield _batch({"shard": [self.number] * len(some), **ids, **{n: v.slice(at, PAGES) for n, v in lists.items()}}, len(some))
        flags = np.fromiter(self.units.values(), np.int32, len(self.units))
        unit, url = (np.fromiter((k[i] for k in self.units), np.int64, len(self.units)) for i in range(2))
        host = np.fromiter((self.own[k[0]] for k in self.units), np.int64, len(self.units))
        for at in range(0, len(unit), CHUNK):
            s = slice(at, at + CHUNK)
            yield _batch({"shard": [self.number], **{n: pa.array([c[s]], _I64) for n, c in zip(("u_unit", "u_url", "u_host"), (unit, url, host))}, "u_flags": pa.array([flags[s]], _I32)}, 1)
        own = np.fromiter(self.own, np.int64, len(self.own))
        for at in range(0, len(own), CHUNK):
            yield _batch({"shard": [self.number], "own": pa.array([own[at : at + CHUNK]], _I64)}, 1)
        local, key, n = self.counted()
        for at in range(0, len(local), CHUNK):
            s = slice(at, at + CHUNK)
            yield _batch({"shard": [self.number], "w_local": pa.array([local[s]], _I64), "w_key": pa.array([key[s]], _I64), "w_n": pa.array([n[s]], _I32)}, 1)


def _lists(values: array, lengths: array) -> pa.ListArray:
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.frombuffer(lengths, np.int32), dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(values, values.typecode)))


def listed(column: pa.ListArray | pa.ChunkedArray) -> list[list[int]]:
    """Lists without nulls, as to_pylist, but made from one list of all."""
    ends = np.cumsum(pc.list_value_length(column).to_numpy()).tolist()
    flat = pc.list_flatten(column).to_numpy().tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _batch(data: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(data[f.name], f.type) if f.name in data and not isinstance(data[f.name], pa.Array) else data.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


def may_say(lines: Lines, contents: pa.Array) -> list[list[int]]:
    """Bits of each line of each content: whether it may say a message, be lorem or have a slot; those that may say one are
    in lines.told afterwards."""
    each = pc.split_pattern(contents, "\n")
    coded = each.values.dictionary_encode()
    found = residue.kinds(coded.dictionary)
    says = functools.reduce(pc.or_, found)
    lines.told.fill(coded.dictionary.filter(says).to_pylist())
    bits = sum(bit * x.to_numpy(zero_copy_only=False).astype(np.int8) for bit, x in ((SAYS, says), (LOREM, found[residue.LOREM_KIND]), (SLOT, residue.slots(coded.dictionary))))
    return listed(pa.ListArray.from_arrays(each.offsets, pa.array(bits[coded.indices.to_numpy()])))


def featured(rows: DataFrame, messages: bool = True) -> DataFrame:
    """See above. rows: result_id, url, title, content; null and blank contents are left out. messages: with what problem 6
    needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        lines, shard = Lines(), Shard(part)
        gc.disable()  # nothing here is a cycle, and there are many small objects
        for batch in (b.slice(at, PAGES) for b in batches for at in range(0, b.num_rows, PAGES)):
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], *([may_say(lines, batch.column(4))] if messages else [])):
                shard.add(lines, *row)
                if shard.chars >= SHARD:
                    yield from shard.rows()
                    shard = Shard(shard.number + 1)
        yield from shard.rows()
        gc.enable()

    has_url = F.col("url").isNotNull()
    pages = rows.where(F.col("content").isNotNull()).where(not_blank(F.col("content"))).select(
        "result_id", F.when(has_url, F.xxhash64(host_of(F.col("url")))).alias("host"), F.when(has_url, F.xxhash64("url")).alias("url"), "title", "content"
    )
    return staged(pages.mapInArrow(run, SCHEMA), "features")


def units_of(features: DataFrame) -> DataFrame:
    """unit, url, host, flags; a shard has each unit and url once."""
    each = features.where("u_unit is not null").select(F.explode(F.arrays_zip("u_unit", "u_url", "u_host", "u_flags")).alias("u"))
    return each.select(*[F.col(f"u.u_{n}").alias(n) for n in ("unit", "url", "host", "flags")])


def words_of(features: DataFrame) -> DataFrame:
    """shard, local, key, n of the words and pairs of each shard."""
    each = features.where("w_key is not null").select("shard", F.explode(F.arrays_zip("w_local", "w_key", "w_n")).alias("w"))
    return each.select("shard", *[F.col(f"w.w_{n}").alias(n) for n in ("local", "key", "n")])
