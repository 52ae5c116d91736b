"""Problem 3: has this key been seen before?

Rows arrive in batches; a batch is cut by its order value into sealed partitions (generations), and keys by hash into
shards. In each shard and generation the new keys are sealed into a minimal perfect hash function (levels of packed bits
with ranks by block; a key's slot is the rank of its bit) and an array of FINGERPRINT_BITS-bit fingerprints by slot, about
2.5 bytes a key in all; they are written to the shared folder, and the keys themselves are dropped. A later key is looked up
in the sealed functions of its shard: at its slot, does the fingerprint agree? Within the current generation an exact set
(the first row of each key) decides. So there are no false negatives, and a false positive only where a fingerprint agrees
by chance. Hits alone are then held exactly against the keys on storage, which gives the measured rate of wrong answers
and takes them out of the result.

Before sharding each key is reduced to its first row per generation, so a key that holds a third of all rows is no hot
shard. Nulls: a null key or order value is never equal to another and never a case; '' is a key like any other. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.common import staged

GENERATIONS = 8
SHARD_KEYS = 250_000
FINGERPRINT_BITS = 16
_LEVELS, _GAMMA, _BLOCK = 24, 2.0, 512


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; wraps around on purpose."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


class _Bits:
    """A packed bit array with the number of set bits before each block."""

    def __init__(self, packed: np.ndarray, size: int):
        self.packed, self.size = packed, size
        ones = np.bitwise_count(packed).astype(np.uint32)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), _BLOCK // 8)))]).astype(np.uint32)

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.packed[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each i."""
        block = i // _BLOCK
        first = block * (_BLOCK // 8)
        whole = self.packed[np.minimum(first[:, None] + np.arange(_BLOCK // 8), len(self.packed) - 1)]
        full = (i >> 3) - first
        counted = np.where(np.arange(_BLOCK // 8) < full[:, None], np.bitwise_count(whole), 0).sum(1)
        part = np.bitwise_count(self.packed[i >> 3] & ((1 << (i & 7)) - 1).astype(np.uint8))
        return self.before[block].astype(np.int64) + counted + part


class Sealed:
    """Minimal perfect hash over distinct 64-bit keys, and fingerprints from a second hash by slot."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, bits: int = FINGERPRINT_BITS):
        self.n, self.bits = len(h1), bits
        self.levels: list[_Bits] = []
        left = np.arange(len(h1))
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(8, int(_GAMMA * len(left)))
            at = (_mix(h1[left], level + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(_Bits(np.packbits(alone, bitorder="little"), size))
            left = left[~alone[at]]
        self.rest = np.sort(h1[left])  # keys that no level could place
        self.prints = np.zeros(self.n, np.uint16)
        self.prints[self.slots(h1)] = h2 & np.uint64((1 << bits) - 1)

    def slots(self, h1: np.ndarray) -> np.ndarray:
        """The slot of each key sealed here; any slot, or -1, for others."""
        out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, b in enumerate(self.levels):
            at = (_mix(h1[left], level + 1) % np.uint64(b.size)).astype(np.int64)
            on = b.at(at)
            out[left[on]] = base + b.rank(at[on])
            left, base = left[~on], base + b.ones
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, h1[left]), len(self.rest) - 1)
            out[left] = np.where(self.rest[at] == h1[left], base + at, -1)
        return out

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether the fingerprint at the key's slot agrees."""
        s = self.slots(h1)
        hit = s >= 0
        hit[hit] = self.prints[s[hit]] == (h2[hit] & np.uint64((1 << self.bits) - 1)).astype(np.uint16)
        return hit

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.bits, len(self.rest), len(self.levels), *(b.size for b in self.levels)], np.int64)
        return b"".join([head.tobytes(), self.rest.tobytes(), self.prints.tobytes(), *(b.packed.tobytes() for b in self.levels)])

    @classmethod
    def from_bytes(cls, data: bytes) -> Sealed:
        self = cls.__new__(cls)
        self.n, self.bits, rest, levels = np.frombuffer(data, np.int64, 4).tolist()
        sizes, at = np.frombuffer(data, np.int64, levels, 32).tolist(), 32 + 8 * levels
        self.rest = np.frombuffer(data, np.uint64, rest, at)
        self.prints = np.frombuffer(data, np.uint16, self.n, at + 8 * rest)
        at += 8 * rest + 2 * self.n
        self.levels = []
        for size in sizes:
            self.levels.append(_Bits(np.frombuffer(data, np.uint8, -(-size // 8), at), size))
            at += -(-size // 8)
        return self


@dataclass
class Seen:
    """What is known of all earlier batches, as tables in the shared folder.

    sealed: shard, part, blob; keys: key, at (order value) of the first row of each key and generation, read for hits only."""

    shards: int
    sealed: DataFrame
    keys: DataFrame


def _step(bits: int):
    def run(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        sealed = [Sealed.from_bytes(b) for b in old.sort_values("part")["blob"]]
        answers, blobs = [], []
        for _, g in new.sort_values("gen", kind="stable").groupby("gen", sort=True):
            g = g.drop_duplicates("h1")  # equal 64-bit hashes of different keys get no answer and are settled exactly
            h1, h2 = g["h1"].to_numpy().view(np.uint64), g["h2"].to_numpy().view(np.uint64)
            hit = np.zeros(len(g), bool)
            for s in sealed:
                hit |= s.lookup(h1, h2)
            answers.append(pd.DataFrame({"shard": g["shard"], "at": g["at"], "hit": hit, "probes": len(sealed), "part": 0, "blob": None}))
            if not hit.all():
                sealed.append(Sealed(h1[~hit], h2[~hit], bits))
                blobs.append(pd.DataFrame({"shard": [g["shard"].iloc[0]], "at": [None], "hit": [None], "probes": [0], "part": [len(sealed)], "blob": [sealed[-1].to_bytes()]}))
        out = answers + blobs
        return pd.concat([x.astype(object) for x in out]) if out else pd.DataFrame(columns=["shard", "at", "hit", "probes", "part", "blob"])

    return run


def arrived(rows: DataFrame, key: str, order: str, seen: Seen | None = None, bits: int = FINGERPRINT_BITS, generations: int = GENERATIONS) -> tuple[DataFrame, Seen]:
    """One batch: (answers, what is known after it). answers: key, at, probes, hit, right of the first row of each key and
    generation; hit is what the look-up says (null: none was made), right what is so. Each call only reads the sealed
    functions of earlier batches. The order values of a batch are larger than those before."""
    base = rows.select(F.col(key).alias("key"), F.col(order).cast("long").alias("ord")).where("key is not null and ord is not null")
    lo, hi, n = base.agg(F.min("ord"), F.max("ord"), F.count("*")).first()
    width = max(1, ((hi or 0) - (lo or 0)) // generations + 1)
    gen = F.floor((F.col("ord") - F.lit(lo or 0)) / F.lit(width)).cast("int")
    firsts = staged(base.groupBy("key", gen.alias("gen")).agg(F.min("ord").alias("at")), "firsts")
    shards = seen.shards if seen else max(1, -(-n // SHARD_KEYS))
    hashed = firsts.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "gen", "at").withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    spark = rows.sparkSession
    old = seen.sealed if seen else spark.createDataFrame([], "shard int, part int, blob binary")
    run = _step(bits)
    got = staged(hashed.groupBy("shard").cogroup(old.withColumnRenamed("shard", "of").groupBy("of")).applyInPandas(lambda new, old: run(new, old), "shard int, at long, hit boolean, probes int, part int, blob binary"), "seen")
    answers = firsts.join(got.where("at is not null").select("at", "hit", "probes"), "at", "left")
    # exact check of hits, and of keys without an answer: does an earlier row have the key?
    doubtful = staged(answers.where("hit or hit is null"), "doubtful")
    keys = firsts.select("key", "at")
    keys = seen.keys.unionByName(keys) if seen else keys
    oldest = keys.join(doubtful.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("at").alias("oldest"))
    settled = doubtful.join(oldest, "key").select("key", "at", "hit", "probes", (F.col("oldest") < F.col("at")).alias("right"))
    all_ = answers.where("not hit").select("key", "at", "hit", "probes", F.lit(False).alias("right")).unionByName(settled)
    blobs = got.where("blob is not null").select("shard", "part", "blob")
    return staged(all_, "answers"), Seen(shards, seen.sealed.unionByName(blobs) if seen else blobs, keys)


def repeats(rows: DataFrame, order: str, key: str, answers: DataFrame, out: str) -> DataFrame:
    """The order values of a batch's rows whose key has come before, from its answers."""
    fresh = answers.where("not right").select(F.col("at").alias(out))
    rows = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(order).cast("long").alias(out))
    return rows.join(fresh, out, "left_anti").distinct()


def seen_before(rows: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """The order values of rows whose key stands in a row with a smaller one; all rows as one batch."""
    return repeats(rows, order, key, arrived(rows, key, order)[0], out)


def error_rate(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row: look-ups, sealed functions probed, hits, wrong hits, and the measured and the expected rate of wrong answers."""
    answers = arrived(rows, key, order)[0].where("hit is not null")
    a = answers.agg(
        F.count("*").alias("lookups"),
        F.coalesce(F.sum("probes"), F.lit(0)).cast("long").alias("probes"),
        F.count_if("hit").alias("hits"),
        F.count_if(F.col("hit") & ~F.col("right")).alias("wrong"),
        F.coalesce(F.sum(F.when(~F.col("right"), F.col("probes")).otherwise(0)), F.lit(0)).alias("open"),
    )
    return a.select("lookups", "probes", "hits", "wrong", F.when(F.col("lookups") > 0, F.col("wrong") / F.col("lookups")).otherwise(0.0).alias("wrong_rate"), F.when(F.col("lookups") > 0, F.col("open") / F.lit(float(1 << FINGERPRINT_BITS)) / F.col("lookups")).otherwise(0.0).alias("expected_rate"))
