"""Fragment merging, contact merging and the size-population cut-off.

The merges are greedy: what one visit does depends on earlier visits nearby.
Spark finds objects, near pairs and touched voxels, and splits each sample into
groups that cannot influence each other; only the small object graph of one
group is replayed in order inside a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from math import prod, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..graph import connected
from ..joins import spread_join
from ..schemas import KEYS, ZYX, field_types
from ..session import is_empty, materialize
from .components import voxel_id
from .labels import apply_lut, volumes_of
from .objects import object_info
from .pairs import bbox_pairs, gaps
from .stencils import face_pairs


def touched(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct (source, target, voxel): voxels of target that share a face with source."""
    keys = list(keys)
    p = face_pairs(labels, keys)
    ab = p.select(*keys, F.col("label_a").alias("source"), F.col("label_b").alias("target"), *[F.col(f"{c}_b").alias(c) for c in ZYX])
    ba = p.select(*keys, F.col("label_b").alias("source"), F.col("label_a").alias("target"), *[F.col(f"{c}_a").alias(c) for c in ZYX])
    return ab.unionByName(ba).select(*keys, "source", "target", voxel_id().alias("voxel")).distinct()


class _Touch:
    """Touched-voxel sets between live objects, merged as objects merge; a merge visits the two objects' neighbours only."""

    def __init__(self, source, target, voxel):
        self.sets: dict[int, dict[int, set]] = {}
        self.into: dict[int, set] = {}  # target -> its sources
        for s, t, v in zip(source, target, voxel):
            self.sets.setdefault(s, {}).setdefault(t, set()).add(v)
            self.into.setdefault(t, set()).add(s)

    def count(self, s, t) -> int:
        return len(self.sets.get(s, {}).get(t, ()))

    def merge(self, drop, keep) -> None:
        for t, vox in self.sets.pop(drop, {}).items():
            self.into[t].discard(drop)
            if t != keep:
                self._add(keep, t, vox)
        for s in self.into.pop(drop, ()):
            vox = self.sets[s].pop(drop)
            if s != keep:
                self._add(s, keep, vox)

    def _add(self, s, t, vox) -> None:
        self.sets.setdefault(s, {}).setdefault(t, set()).update(vox)
        self.into.setdefault(t, set()).add(s)


WIDE = 4096  # grid cells a box may cover before it is looked at on every visit


class _Boxes:
    """Grid of live boxes: what lies near a box, and whether anything there changed since a given step.

    Cells are about as wide as a box with its margin, so a visit looks at the objects around it and not at the
    whole group.
    """

    def __init__(self, lo: list, hi: list, margin: float):
        n = len(lo)
        self.lo, self.hi, self.margin = lo, hi, margin
        self.width = [max(1.0, sum(h[c] - l[c] for l, h in zip(lo, hi)) / n + margin) for c in range(3)]
        self.cells: dict[tuple, list] = {}
        self.changed: dict[tuple, int] = {}
        self.wide: dict[int, None] = {}
        self.wide_changed = 0
        self.spans: list = [None] * n
        for i in range(n):
            self._list(i)

    def _span(self, i: int, m: float) -> list[range]:
        lo, hi = self.lo[i], self.hi[i]
        return [range(int((lo[c] - m) // w), int((hi[c] + m) // w) + 1) for c, w in enumerate(self.width)]

    def _list(self, i: int) -> None:
        old, new = self.spans[i], self._span(i, 0.0)
        if i in self.wide or old == new:
            return
        if prod(map(len, new)) > WIDE:
            self.wide[i] = None
            return
        self.spans[i] = new
        for at in product(*new):
            if old is None or not all(a in r for a, r in zip(at, old)):
                self.cells.setdefault(at, []).append(i)

    def near(self, i: int) -> set[int]:
        """Objects that may lie within the margin, dead ones included."""
        out = set(self.wide)
        for at in product(*self._span(i, self.margin)):
            out.update(self.cells.get(at, ()))
        return out

    def grown(self, i: int, step: int) -> None:
        """Box ``i`` took in another one at ``step``."""
        self._list(i)
        if i in self.wide:
            self.wide_changed = step
        else:
            for at in product(*self.spans[i]):
                self.changed[at] = step

    def quiet_since(self, i: int, step: int) -> bool:
        if self.wide_changed > step:
            return False
        return all(self.changed.get(at, -1) <= step for at in product(*self._span(i, self.margin)))


def _final_ids(parent: dict) -> list[tuple[int, int]]:
    out = []
    for label in parent:
        end = label
        while parent[end] != end:
            end = parent[end]
        out.append((label, end))
    return out


def _replay_safe(objs: pd.DataFrame, near: set, touch: _Touch, max_gap, min_contact, gt_min, passes=200):
    ids = objs["label"].astype("int64").tolist()
    vol = objs["volume_vox"].astype("int64").tolist()
    cen = objs[["cz", "cy", "cx"]].to_numpy().tolist()
    lo = objs[["z0", "y0", "x0"]].to_numpy().astype("float64").tolist()
    hi = objs[["z1", "y1", "x1"]].to_numpy().astype("float64").tolist()
    margin = float(objs["margin"].iloc[0])
    live = [True] * len(ids)
    parent = {i: i for i in ids}
    links: dict[int, set] = {}
    for a, b in near:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    boxes = _Boxes(lo, hi, margin)
    visited: list = [None] * len(ids)
    step = 0
    for _ in range(passes):
        start = [f for f in range(len(ids)) if live[f] and vol[f] < gt_min]
        merged = False
        for f in sorted(start, key=vol.__getitem__):
            # A visit that changed nothing ends the same way until something near changes.
            if not live[f] or (visited[f] is not None and boxes.quiet_since(f, visited[f])):
                continue
            visited[f] = step
            mine, (cz, cy, cx) = vol[f], cen[f]
            (lz, ly, lx), (hz, hy, hx) = [v - margin for v in lo[f]], [v + margin for v in hi[f]]
            best, t = None, -1
            for o in boxes.near(f):
                if not live[o] or vol[o] <= mine:
                    continue
                a, b = lo[o], hi[o]
                if hz < a[0] or hy < a[1] or hx < a[2] or b[0] < lz or b[1] < ly or b[2] < lx:
                    continue
                c = cen[o]
                dz, dy, dx = c[0] - cz, c[1] - cy, c[2] - cx
                away = sqrt(dz * dz + dy * dy + dx * dx)
                if best is None or away < best or (away == best and o < t):
                    best, t = away, o
            if best is None:
                continue
            fid, tid = ids[f], ids[t]
            if tid not in links.get(fid, ()) and touch.count(fid, tid) < min_contact:
                continue
            merged = True
            step += 1
            live[f] = False
            parent[fid] = tid
            both = vol[t] + mine
            cen[t] = [(p * vol[t] + q * mine) / both for p, q in zip(cen[t], cen[f])]
            vol[t] = both
            lo[t], hi[t] = list(map(min, lo[t], lo[f])), list(map(max, hi[t], hi[f]))
            boxes.grown(t, step)
            touch.merge(fid, tid)
            for o in links.pop(fid, set()):
                links[o].discard(fid)
                if o != tid:
                    links[o].add(tid)
                    links.setdefault(tid, set()).add(o)
        if not merged:
            break
    return _final_ids(parent)


def _replay_contact(objs: pd.DataFrame, touch: _Touch, threshold, passes=50):
    ids = [int(i) for i in objs["label"]]
    vol = dict(zip(ids, objs["volume_vox"].astype(int)))
    parent = {i: i for i in ids}
    live = dict.fromkeys(ids)
    for _ in range(passes):
        merged = False
        for f in sorted(sorted(live), key=lambda i: vol[i]):
            if f not in live:
                continue
            for t in sorted(touch.sets.get(f, ())):
                if t not in live or touch.count(f, t) < threshold:
                    continue
                keep, drop = (t, f) if vol[t] >= vol[f] else (f, t)
                vol[keep] += vol[drop]
                del live[drop]
                parent[drop] = keep
                touch.merge(drop, keep)
                merged = True
                break
        if not merged:
            break
    return _final_ids(parent)


def _grouped(objs: DataFrame, links: DataFrame, roots: DataFrame, keys: Sequence[str], run) -> DataFrame:
    """Run ``run(objects, links)`` per group of ``roots`` (label -> group); returns (label, new_label)."""
    keys = list(keys)
    schema = T.StructType(
        [*field_types(objs, keys), T.StructField("label", T.IntegerType()), T.StructField("new_label", T.IntegerType())]
    )
    o = objs.join(roots, [*keys, "label"])
    own = roots.select(*keys, F.col("label").alias("source"), F.col("_group").alias("_group"))
    e = materialize(links.join(own, [*keys, "source"]), "links")

    def go(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("label", ignore_index=True)
        pairs = run(left, right)
        out = pd.DataFrame(pairs, columns=["label", "new_label"]).astype("int32")
        for k, v in zip(keys, key):
            out[k] = v
        return out[schema.names]

    return o.groupBy(*keys, "_group").cogroup(e.groupBy(*keys, "_group")).applyInPandas(go, schema)


def safe_merge(
    labels: DataFrame,
    scales: DataFrame,
    max_gap: float = 1.0,
    min_contact: int = 10,
    gt_min: float = 10230,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Merge fragments below ``gt_min`` into their nearest larger neighbour when close or touching enough."""
    keys = list(keys)
    fine = F.least("sz", "sy", "sx")
    objs = spread_join(object_info(labels, keys), scales.select(*keys, (F.lit(max_gap) / fine + 2).alias("margin")), keys, ["label"])
    objs = materialize(objs, "objects")
    near = bbox_pairs(objs, objs, F.col("margin"), keys).filter("a_label < b_label")
    near = materialize(near.select(*keys, F.col("a_label").alias("a"), F.col("b_label").alias("b")), "near")
    close = gaps(labels, near, scales, keys).filter(F.col("gap_um") <= max_gap).select(*keys, "a", "b")
    close = materialize(close, "close")
    touch = materialize(touched(labels, keys), "touched")

    # Objects that might ever fuse form clusters. Only a cluster with a small object can
    # change; such clusters share a group when their boxes come near each other, since
    # one can then alter what the other picks. All other objects stay as they are and
    # are only shown to the groups they lie near.
    fuse = close.unionByName(touch.select(*keys, F.col("source").alias("a"), F.col("target").alias("b")))
    cluster = connected(fuse, keys).withColumnsRenamed({"node": "label", "root": "_c"})
    box = [f"{c}{e}" for e in "01" for c in ZYX]
    member = objs.join(cluster, [*keys, "label"])
    boxes = member.groupBy(*keys, "_c").agg(
        F.max("margin").alias("margin"), F.min("volume_vox").alias("_least"),
        *[F.min(f"{c}0").alias(f"{c}0") for c in ZYX], *[F.max(f"{c}1").alias(f"{c}1") for c in ZYX],
    )
    boxes = materialize(boxes.filter(F.col("_least") < gt_min), "clusters")
    meet = bbox_pairs(boxes, boxes, F.col("margin"), keys).filter("a__c < b__c")
    group = connected(meet.select(*keys, F.col("a__c").alias("a"), F.col("b__c").alias("b")), keys)
    boxes = boxes.join(group.withColumnsRenamed({"node": "_c", "root": "_group"}), [*keys, "_c"], "left")
    boxes = materialize(boxes.withColumn("_group", F.coalesce("_group", "_c").cast("long")), "groups")
    inside = member.select(*keys, "label", "_c").join(boxes.select(*keys, "_c", "_group"), [*keys, "_c"])
    inside = inside.select(*keys, "label", "_group")
    still = objs.join(inside, [*keys, "label"], "left_anti").select(*keys, "label", *box)
    seen = bbox_pairs(boxes.select(*keys, "_group", "margin", *box), still, F.col("margin"), keys)
    seen = seen.select(*keys, F.col("b_label").alias("label"), F.col("a__group").alias("_group")).distinct()
    roots = materialize(inside.unionByName(seen), "members")
    links = close.select(*keys, F.col("a").alias("source"), F.col("b").alias("target"), F.lit(-1).cast("long").alias("voxel"))

    def run(left, right):
        pair = right["voxel"] < 0
        close_pairs = set(zip(right.loc[pair, "source"].tolist(), right.loc[pair, "target"].tolist()))
        sets = right[~pair]
        touch = _Touch(sets["source"].tolist(), sets["target"].tolist(), sets["voxel"].tolist())
        return _replay_safe(left, close_pairs, touch, max_gap, min_contact, gt_min)

    lut = _grouped(objs, links.unionByName(touch), roots, keys, run).filter("label <> new_label")
    moved = labels.join(lut, [*keys, "label"], "left")
    return moved.select(*keys, *ZYX, F.coalesce("new_label", "label").alias("label"))


def large_contact_merge(labels: DataFrame, threshold: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Merge any two objects that share at least ``threshold`` contact voxels; the larger keeps its id.

    Contact only grows when objects merge, so which objects end up together does
    not depend on the order: that closure is found first, over the cluster. Only
    the surviving id depends on the order and is replayed per closed group.
    """
    keys = list(keys)
    touch = materialize(touched(labels, keys), "touched")
    objs = volumes_of(labels, keys)
    roots = labels.select(*keys, "label").distinct().withColumn("_group", F.col("label").cast("long"))
    roots = materialize(roots, "groups")
    while True:
        src = roots.withColumnsRenamed({"label": "source", "_group": "a"})
        dst = roots.withColumnsRenamed({"label": "target", "_group": "b"})
        pairs = touch.join(src, [*keys, "source"]).join(dst, [*keys, "target"]).filter("a <> b")
        strong = (
            pairs.select(*keys, "a", "b", "voxel").distinct().groupBy(*keys, "a", "b").count().filter(F.col("count") >= threshold)
        )
        strong = materialize(strong.select(*keys, "a", "b"), "strong")
        if is_empty(strong):
            break
        up = connected(strong, keys).withColumnsRenamed({"node": "_group", "root": "_up"})
        roots = roots.join(up, [*keys, "_group"], "left")
        roots = materialize(roots.select(*keys, "label", F.coalesce("_up", "_group").alias("_group")), "groups")
    inner = touch.join(roots.withColumnsRenamed({"label": "source", "_group": "_s"}), [*keys, "source"])
    inner = inner.join(roots.withColumnsRenamed({"label": "target", "_group": "_t"}), [*keys, "target"])
    inner = inner.filter("_s = _t").select(*keys, "source", "target", "voxel")

    def run(left, right):
        touch = _Touch(right["source"].tolist(), right["target"].tolist(), right["voxel"].tolist())
        return _replay_contact(left, touch, threshold)

    # Only groups with more than one member need a replay.
    sizes = roots.groupBy(*keys, "_group").count()
    many = roots.join(sizes.filter("count > 1"), [*keys, "_group"], "left_semi")
    single = roots.join(sizes.filter("count = 1"), [*keys, "_group"], "left_semi")
    lut = _grouped(objs, inner, many, keys, run).unionByName(
        single.select(*keys, F.col("label").cast("int"), F.col("label").cast("int").alias("new_label"))
    )
    return apply_lut(labels, lut, keys)


def fit_mixture(x: np.ndarray, w: np.ndarray, k: int = 3, tol: float = 1e-3, rounds: int = 100, floor: float = 1e-6):
    """EM for a 1-D Gaussian mixture on weighted values; starts from weighted quantile groups."""
    order = np.argsort(x)
    x, w = x[order], w[order].astype("float64")
    mid = (np.cumsum(w) - w / 2) / w.sum()
    centre = np.array([x[np.argmin(np.abs(mid - (i + 0.5) / k))] for i in range(k)])
    for _ in range(50):
        near = np.argmin(np.abs(x[:, None] - centre[None]), axis=1)
        new = np.array([np.average(x[near == i], weights=w[near == i]) if (near == i).any() else centre[i] for i in range(k)])
        if np.allclose(new, centre):
            break
        centre = new
    resp = np.eye(k)[near]
    last = -np.inf
    for _ in range(rounds):
        mass = (resp * w[:, None]).sum(axis=0) + 10 * np.finfo(float).eps
        mean = (resp * (w * x)[:, None]).sum(axis=0) / mass
        var = (resp * (w[:, None] * (x[:, None] - mean) ** 2)).sum(axis=0) / mass + floor
        share = mass / mass.sum()
        log_p = np.log(share) - 0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
        top = log_p.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log_p - top).sum(axis=1))
        resp = np.exp(log_p - total[:, None])
        bound = float((total * w).sum() / w.sum())
        if abs(bound - last) < tol:
            break
        last = bound
    rank = np.argsort(mean)
    return mean[rank], var[rank], share[rank]


def gmm_params(sizes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Three-part mixture of log1p(volume) per sample: mean_i, var_i, w_i (i = 0 small .. 2 large).

    The fit sees (distinct volume, count) rows. A sample of V voxels has at most
    sqrt(2 V) distinct volumes, so the rows of one task stay small.
    """
    keys = list(keys)
    hist = sizes.groupBy(*keys, "volume_vox").agg(F.count("*").alias("n"))
    names = [f"{p}_{i}" for p in ("mean", "var", "w") for i in range(3)]
    schema = T.StructType([*field_types(sizes, keys), T.StructField("n_objects", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        if n < 3:
            values = [None] * 9
        else:
            values = np.concatenate(fit_mixture(np.log1p(pdf["volume_vox"].to_numpy("float64")), pdf["n"].to_numpy())).tolist()
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], n, *values]], columns=schema.names)

    return hist.groupBy(*keys).applyInPandas(fit, schema)


def gmm_cutoff(mu_a: Column, var_a: Column, w_a: Column, mu_b: Column, var_b: Column, w_b: Column) -> Column:
    """expm1 of the point where two weighted Gaussians cross; the root between the means is preferred."""
    va, vb = F.greatest(var_a, F.lit(1e-12)), F.greatest(var_b, F.lit(1e-12))
    wa, wb = F.greatest(w_a, F.lit(1e-12)), F.greatest(w_b, F.lit(1e-12))
    a = 1.0 / (va * 2) - 1.0 / (vb * 2)
    b = mu_b / vb - mu_a / va
    c = mu_a * mu_a / (va * 2) - mu_b * mu_b / (vb * 2) + F.log(wb * F.sqrt(va) / (wa * F.sqrt(vb)))
    disc = b * b - a * c * 4
    mid = (mu_a + mu_b) * 0.5
    r1, r2 = (-b + F.sqrt(disc)) / (a * 2), (-b - F.sqrt(disc)) / (a * 2)
    lo, hi = F.least(mu_a, mu_b), F.greatest(mu_a, mu_b)
    t = (
        F.when(F.abs(a) < 1e-12, -c / F.greatest(b, F.lit(1e-12)))
        .when(disc < 0, mid)
        .when((r1 >= lo) & (r1 <= hi), r1)
        .when((r2 >= lo) & (r2 <= hi), r2)
        .when(F.abs(r1 - mid) < F.abs(r2 - mid), r1)
        .otherwise(r2)
    )
    return F.expm1(t)


def gmm_cleanup(labels: DataFrame, keys: Sequence[str] = KEYS):
    """Drop objects smaller than the mid/large crossing. Returns (labels, cut-offs with n_removed)."""
    keys = list(keys)
    sizes = volumes_of(labels, keys)
    cut = gmm_cutoff(*[F.col(f"{p}_{i}") for i in (1, 2) for p in ("mean", "var", "w")])
    cuts = gmm_params(sizes, keys).select(*keys, F.coalesce(cut, F.lit(0.0)).alias("cutoff_vox"))
    cuts = materialize(cuts, "cuts")
    small = spread_join(sizes, cuts, keys, ["label"]).filter("volume_vox < cutoff_vox")
    removed = cuts.join(small.groupBy(*keys).agg(F.count("*").alias("n_removed")), keys, "left").na.fill(0, ["n_removed"])
    return labels.join(small, [*keys, "label"], "left_anti"), removed
