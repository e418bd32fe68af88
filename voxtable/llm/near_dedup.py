"""Near duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

Two documents are linked when 100 * |A & B| >= 75 * |A | B| over their distinct 5-word shingles.  What is
returned are the groups that links form, so a pair is only looked at while its two ends are still in different
groups.  That keeps a bucket of thousands of near copies linear:

1. Documents with the same shingle set form a class, and only its smallest id goes on.  Of buckets that hold the same
   documents one goes on, with their number as its weight.
2. Each band bucket is compared as a star: members against its smallest id.  In the first
   round a document is compared with one such leader only, the one it shares most buckets with, and the links that
   result are grouped; buckets whose members all came out in one group are finished.  Rounds go on, with more leaders
   for the documents that are left, until no leader is left to compare with.
3. In the remaining buckets, documents meet where they also share a rare shingle: two sets can only be similar
   enough if they share one of each set's rarest quarter.  Keys (bucket, shingle) are merged like buckets, and stars
   over them are settled in the same rounds.
4. What then still mixes groups is compared pair by pair, within a bucket and a rare shingle and where sizes allow it.

Every comparison is on the full sets, and no bucket is cut short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import is_empty, materialize
from . import textarrays as ta
from .grouping import components

SLOTS, ROWS = 128, 4  # 32 bands of 4: a pair at similarity 0.75 is missed with probability 5e-6
SHINGLE, NUM, DEN = 5, 75, 100
U = np.uint64
CHUNK = 1 << 16
STEP = 64  # growth of the leaders a document is compared with, from round to round


def superminhash(values: list[np.ndarray], m: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` values per set.

    Element x draws a random permutation and numbers r_0, r_1, ..; step j offers j + r_j to slot perm[j].  All
    elements take step j together; a set is finished when none of its slots can still fall, which for large sets
    is after two or three steps.  Values are fixed-point, j in the top byte.  Rows of empty sets stay at the top value.
    """
    n_sets = len(values)
    sig = np.full(n_sets * m, U(m) << U(56), dtype=np.uint64)
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    flat = np.concatenate(values) if n_sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n_sets), sizes)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    # whole sets per chunk, so that stopping early is decided on complete rows; one huge set is a chunk by itself
    a = 0
    while a < n_sets:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK, "right")) - 1)
        b = min(b, n_sets)
        _offer(flat[bounds[a]: bounds[b]], owner[bounds[a]: bounds[b]], sig, m)
        a = b
    return sig.reshape(n_sets, m)


def _offer(x: np.ndarray, d: np.ndarray, sig: np.ndarray, m: int) -> None:
    if not len(x):
        return
    lo, hi = int(d[0]), int(d[-1]) + 1
    rows = sig.reshape(-1, m)
    perm = np.empty((min(len(x), 4 * CHUNK), m), dtype=np.uint8 if m <= 256 else np.uint16)
    for at in range(0, len(x), len(perm)):  # a huge set passes in parts; minima do not depend on the order
        xs, ds = x[at: at + len(perm)], d[at: at + len(perm)]
        p = perm[: len(xs)]
        p[:] = np.arange(m, dtype=p.dtype)
        live = np.arange(len(xs))
        for j in range(m):
            draw = ta.mix(xs + U((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
            k = j + ((((draw & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64))
            slot = p[live, k]
            p[live, k] = p[live, j]
            fraction = ta.mix(draw ^ U(0xD1B54A32D192ED03)) >> U(8)
            np.minimum.at(sig, ds * m + slot, (U(j) << U(56)) | fraction)
            open_sets = rows[lo:hi].max(axis=1) >= (U(j + 1) << U(56))
            stay = open_sets[ds - lo]
            if not stay.all():
                if not stay.any():
                    break
                live, xs, ds = live[stay], xs[stay], ds[stay]


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different bands never sharing keys on purpose."""
    n, m = sig.shape
    parts = sig.reshape(n, m // rows, rows)
    key = np.full((n, m // rows), U(0x2545F4914F6CDD1D), dtype=np.uint64) * np.arange(1, m // rows + 1, dtype=np.uint64)
    for j in range(rows):
        key = ta.mix(key * U(0xD6E8FEB86659FD93) + parts[:, :, j])
    return key


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ta.worker_cache("near_dedup")
    for b in batches:
        buf, offs = ta.text_bytes(b.column(1))
        ids = b.column(0)
        for s, e in ta.slices(offs):
            sets = ta.shingles(buf[offs[s]: offs[e]], offs[s: e + 1] - offs[s], SHINGLE)
            keys = band_keys(superminhash(sets)).view(np.int64)
            width = keys.shape[1]
            has = np.array([len(v) > 0 for v in sets])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(has * width))), pa.int32()), pa.array(keys[has].ravel()))
            digests = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() if len(v) else None for v in sets]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(s, e - s), pa.array([len(v) for v in sets], pa.int64()), pa.array(digests, pa.binary()), lists],
                names=["id", "n_shingles", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ta.worker_cache("near_dedup")
    for b in batches:
        buf, offs = ta.text_bytes(b.column(1))
        for s, e in ta.slices(offs):
            sets = ta.shingles(buf[offs[s]: offs[e]], offs[s: e + 1] - offs[s], SHINGLE)
            sizes = np.array([len(v) for v in sets])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
                pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), lists], names=["id", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that are similar enough on their full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    low, high = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(one, "a").join(two, "b")
        .filter(low * DEN >= high * NUM)
        .filter(both * DEN >= (F.size("sa") + F.size("sb") - both) * NUM)
        .select("a", "b")
    )


def _merged(keyed: DataFrame) -> DataFrame:
    """``keyed`` (key, id, weight, ..) of keys with two documents at least; of keys with the same documents one, their weights added.

    Documents are compared by two sums of 31 hash bits, besides the least, the greatest and the number.
    """
    h = F.xxhash64("id")
    keys = keyed.groupBy("key").agg(
        F.min("id").alias("lead"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size"), F.max("weight").alias("weight"),
        F.sum(h.bitwiseAND((1 << 31) - 1)).alias("h0"), F.sum(F.shiftrightunsigned(h, 33)).alias("h1")).filter("lead < last")
    keys = keys.groupBy("lead", "last", "size", "h0", "h1").agg(F.min("key").alias("key"), F.sum("weight").alias("weight"))
    return keyed.drop("weight").join(keys.select("key", "weight"), "key")


def _rare(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, id, weight, n, ahead): each bucket of ``mixed`` (key, id, weight) again for every rare shingle of its documents.

    With n shingles, n - ceil(0.75 n) + 1 of the rarest suffice: similar sets share at least 0.75 n of them.
    ``ahead`` counts the document's shingles from this one on, in the order from rare to frequent.
    """
    rows = materialize(mixed.select("id").distinct().join(sets, "id").select(
        "id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "mixed-shingles")
    freq = materialize(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "mixed-frequencies")
    ranked = rows.join(freq, "shingle").groupBy("id", "n").agg(
        F.count(F.lit(1)).alias("shared"), F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("order"))
    # shingles that only one document holds come first in the order, and match nothing
    need = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1 - (F.col("n") - F.col("shared"))
    rare = ranked.filter(need > 0).select(
        "id", "n", "shared", F.posexplode(F.transform(F.slice("order", F.lit(1), need.cast("int")), lambda o: o["shingle"])).alias("at", "shingle"))
    both = mixed.select("key", "id", "weight").join(rare, "id").select(
        F.xxhash64("key", "shingle").alias("key"), "id", "weight", "n", (F.col("shared") - F.col("at")).alias("ahead"))
    return _merged(both)


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) within a key whose groups differ and that can be similar enough by their sizes n and by ``ahead``.

    At the rarest shingle that two sets share, all they share still lies ahead in both; so there, if they are similar,
    the smaller ``ahead`` reaches the 0.75 / 1.75 of both sizes that they share.  Other keys of the pair may be passed over.
    For the smaller of the two sets that is 1.5 / 1.75 of its own size at least.
    """
    short = rows.filter(F.col("ahead") * (NUM + DEN) >= F.col("n") * (2 * NUM)).select(
        "key", F.col("id").alias("a"), F.col("grp").alias("ga"), F.col("n").alias("na"), F.col("ahead").alias("ha"))
    other = rows.select("key", F.col("id").alias("b"), F.col("grp").alias("gb"), F.col("n").alias("nb"), F.col("ahead").alias("hb"))
    fits = (f"(na < nb or na = nb and a < b) and ga <> gb and na * {DEN} >= nb * {NUM} "
            f"and least(ha, hb) * {NUM + DEN} >= (na + nb) * {NUM}")
    return short.join(other, "key").filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class _Groups:
    """Links found so far, the groups they form, and the pairs that need no second look."""

    def __init__(self, sets: DataFrame):
        self.sets, self.links, self.tried, self.groups = sets, None, None, None

    def of(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` (key, id, ..) of keys that mix groups, with ``grp``."""
        rows = keyed.withColumn("grp", F.col("id"))
        if self.groups is not None:
            rows = keyed.join(self.groups, keyed["id"] == self.groups["node"], "left")
            rows = rows.withColumn("grp", F.coalesce("root", "id")).drop("node", "root")
        keys = rows.groupBy("key").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).filter("g0 < g1").select("key")
        return rows.join(keys, "key")

    def test(self, pairs: DataFrame) -> bool:
        """Verify pairs (a, b), written already, and join what they link; whether groups may have changed."""
        found = materialize(_verified(pairs, self.sets), "links")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        if is_empty(found):
            return False
        self.links = found if self.links is None else found.unionByName(self.links)
        self.groups = materialize(components(self.links), "groups")
        return True

    def settle(self, keyed: DataFrame, first: int = 1) -> DataFrame:
        """Compare members of ``keyed`` (key, id, weight, ..) with leaders until none is left; rows of keys still mixed, with ``grp``.

        A key's leader is the smallest member of its smallest group, so leaders fall as groups join.  A document meets
        ``first`` leaders in the first round and STEP times as many in each further one.  Rounds end when nothing was
        linked and no document has a leader left over.
        """
        quota, changed = first, True
        if self.groups is None:  # written already, and every key holds two documents at least
            keyed, changed = keyed.withColumn("grp", F.col("id")), False
        while True:
            keyed = materialize(self.of(keyed.drop("grp")), "mixed") if changed else keyed
            lead = keyed.groupBy("key").agg(F.min(F.struct("grp", "id")).alias("l"))
            pairs = keyed.join(lead, "key").filter("grp <> l.grp").select(
                F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b"), "id", "weight")
            pairs = pairs.groupBy("a", "b", "id").agg(F.sum("weight").alias("shared"))
            if self.tried is not None:
                pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
            rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "a", "b"))
            best = materialize(pairs.withColumn("r", rank).filter(F.col("r") <= quota)
                               .groupBy("a", "b").agg(F.max("r").alias("r")), "stars")
            if is_empty(best):
                return keyed
            changed = self.test(best.select("a", "b"))
            if not changed and is_empty(best.filter(F.col("r") == quota)):
                return keyed
            quota *= STEP


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept).

    ``component_id`` is the smallest id reachable over links, itself included.  Null and empty texts, and texts
    without a word, have no shingles and are linked with nothing.  Texts of under five words are one shingle.
    Rows without an id give no row; rows that repeat an id are read as one document each and share its group.
    Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    sketch = materialize(rows.mapInArrow(_sketch, "id long, n_shingles long, digest binary, bands array<long>"), "sketch")
    classes = materialize(
        sketch.filter("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last"),
        "classes").select("digest", "rep")
    members = sketch.select("id", "n_shingles", "digest").join(classes, "digest", "left")
    members = members.select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"))

    alone = sketch.filter("n_shingles > 0").join(classes, "digest", "left").filter("rep is null or rep = id")
    banded = alone.select("id", F.explode("bands").alias("key"))
    shared = materialize(_merged(banded.withColumn("weight", F.lit(1))), "buckets")
    sets = materialize(rows.join(shared.select("id").distinct(), "id", "left_semi").mapInArrow(_sets, "id long, shingles array<long>")
                       .dropDuplicates(["id"]), "sets")

    found = _Groups(sets)
    mixed = found.settle(shared)
    if not is_empty(mixed):
        mixed = found.settle(_rare(mixed, sets), STEP)
        pairs = _across(mixed)
        rest = materialize(pairs.join(found.tried, ["a", "b"], "left_anti") if found.tried is not None else pairs, "pairs")
        if not is_empty(rest):
            found.test(rest)
    if found.groups is None:
        return members.select(F.col("id").alias(id_col), "n_shingles", F.col("rep").alias("component_id"), (F.col("id") == F.col("rep")).alias("kept"))
    groups = found.groups
    root = F.coalesce("root", "rep")
    return members.join(groups, members["rep"] == groups["node"], "left").select(
        F.col("id").alias(id_col), "n_shingles", root.alias("component_id"), (F.col("id") == root).alias("kept"))
