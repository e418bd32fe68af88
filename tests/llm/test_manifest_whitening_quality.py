"""Merkle manifest, embedding whitening and quality classifier next to brute force, and on awkward rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from voxtable.llm import quality
from voxtable.llm.merkle import audit, build_manifest, fold, prove, siblings
from voxtable.llm.whitening import eigen, polar_sign, whiten

DOC = "doc_id long, text string, lang string, source string, n_chars long, root string, grp string, idx int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text=None):
    values = (row[0], row[3], row[2], row[4], row[1] if text is None else text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def by_hand(rows):
    """Sorted (id, leaf, subroot, root, proof, folded root, verified)."""

    def climb(digests):
        """Root, and per leaf its (left, right) siblings upwards."""
        at, paths = list(range(len(digests))), [[] for _ in digests]
        while len(digests) > 1:
            for leaf, i in enumerate(at):
                a = i // 8 * 8
                paths[leaf].append(("".join(digests[a:i]), "".join(digests[i + 1: a + 8])))
                at[leaf] = i // 8
            digests = [sha(*digests[a: a + 8]) for a in range(0, len(digests), 8)]
        return digests[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = climb([leaf_of(r) for r in groups[g]])
    root, above = climb([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for r, path in zip(groups[g], trees[g][1]):
            path = path + above[k]
            now = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in path:
                now = sha(left, now, right)
            out.append((r[0], leaf_of(r), trees[g][0], root, sha(*(a + b for a, b in path)), now, now == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], DOC)


def documents(n, langs):
    return [(i, f"Text {i} Ä", langs[i * i % len(langs)], "s" if i % 3 else None, i * 7) for i in range(n)]


@pytest.mark.parametrize("rows", [
    [(5, "One", "en", "s", 3)],
    documents(8, ["en"]),
    documents(65, ["en"]),
    documents(150, [None, "", "de", "en", "é", "zh", "A", "b", "c", "d", "~"]),  # more groups than one run holds
    [(1, None, None, None, None), (1, "A", None, None, None), (None, "B", "x", None, 2), (2, "", "x", "", 0), (3, "Long " * 50_000, "x", "s", 1)],
    [(7, "Same", "en", "s", 4)] * 20 + documents(3, ["en"]),
], ids=["lone", "one run", "65", "many groups", "odd", "repeats"])
def test_manifest_by_hand(spark, rows):
    assert rows_of(audit(table(spark, rows))) == by_hand(rows)


def test_manifest_of_nothing(spark):
    empty = table(spark, [(1, "a", "b", "c", 1)]).filter("doc_id < 0")
    assert audit(empty).collect() == [] and build_manifest(empty).root is None


def test_proofs_of_some_ids(spark):
    rows = documents(200, ["en", "de", None])
    m = build_manifest(table(spark, rows))
    some = prove(m, spark.createDataFrame([(3,), (77,), (77,), (999,)], "id long"))
    got = {r["id"]: r for r in some.select("id", "digest", fold(some["path"], some["digest"]).alias("root"), siblings(some["path"]).alias("s")).collect()}
    assert set(got) == {3, 77} and all(r["root"] == m.root for r in got.values())
    want = {r[0]: r[4] for r in by_hand(rows)}
    assert {i: sha(r["s"]) for i, r in got.items()} == {i: want[i] for i in got}
    moved = prove(build_manifest(table(spark, rows[:-1])))
    assert moved.select(fold(moved["path"], moved["digest"])).distinct().count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigen(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n)) * rng.exponential(1, n)
    a = a @ a.T
    e, v = eigen(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * max(e[0], 1))
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-13 and np.abs(a @ v - v * e).max() < 1e-13 * max(e[0], 1)


@pytest.mark.parametrize("values", [[0.0, 0, 0], [1.0, 1, 1, 1], [5.0, 2, 2, 1, 1, 0], [2.0, 1, 0], [1e8, 1, 1e-8], [3.0, 3, 3, -3]])
def test_eigen_with_ties_and_shifts_on_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))
    a = q @ np.diag(values) @ q.T
    e, v = eigen(a)
    top = max(np.abs(values).max(), 1)
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-13 * top and np.abs(v.T @ v - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ v - v * e).max() < 1e-13 * top


def test_polar_factor():
    a = np.random.default_rng(3).standard_normal((20, 20))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert np.abs(polar_sign(a) - v @ np.diag(np.sign(e)) @ v.T).max() < 1e-12


def whitened_by_hand(vectors, k=4):
    x = np.floor(256 * np.array(vectors, float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    m = fit - s / n
    e, v = np.linalg.eigh(m.T @ m / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), np.abs((x - s / n) @ v / np.sqrt(e)), e / np.trace(m.T @ m / n)


def check_whitening(df, ids, vectors):
    n, deviation, z, share = whitened_by_hand(vectors)
    got = sorted(df.collect(), key=lambda r: (r["vec_id"], r["component"]))
    k = z.shape[1]
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c) for i in ids for c in range(1, k + 1)]
    assert {r["n"] for r in got} == {n} and [r["deviation"] for r in got[::k]] == deviation.tolist()
    assert np.allclose([abs(r["whitened"]) for r in got], z.ravel(), atol=1e-9)
    assert np.allclose([r["explained"] for r in got[:k]], share, rtol=1e-9) and got[0]["identity_error"] < 1e-9


def test_whitening_query(spark, sf):
    rows = sorted(duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall())
    check_whitening(entry.queries()["op11_embedding_whitening"](spark, sf), [r[0] for r in rows], [r[1] for r in rows])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = rng.standard_normal((40, 5)).astype(float).tolist()
    good += [good[0]] * 30  # one vector counts once in the fit
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan"), 1.0, 1.0, 1.0, 1.0], [float("inf")] * 5, [1.0, 2.0]]
    rows = [(i, v, 1, 2.0) for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, whitened double")
    check_whitening(whiten(df), list(range(len(good))), good)
    assert whiten(df.filter("vec_id < 0")).collect() == []
    one = whiten(df.filter("vec_id = 3")).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(c, 1, 0, 0.0, None) for c in (1, 2, 3, 4)]
    two = whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.25, 2.0]), (2, [0.25, 2.0])], "vec_id long, embedding array<float>"))
    assert two.count() == 6


def test_whitening_beyond_long(spark):
    df = spark.createDataFrame([(1, [1e13, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whiten(df).collect()} == {None}


def held_out(spark, sf, of, by):
    scored = of(spark, sf).toPandas()
    labels = duckdb.sql(f"select doc_id, {by} as y from '{sf}/labels.parquet' where {by} is not null").df()
    return scored[scored.held_out].merge(labels, on="doc_id")


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    t = held_out(spark, sf, entry.queries()["op13_quality"], "quality")
    good, bad = t[t.y == 1], t[t.y == 0]
    assert (good.predicted == 1).mean() >= 0.95 and (bad.predicted == 0).mean() >= 0.8
    assert (good.score.values[:, None] > bad.score.values[None, :]).mean() >= 0.97  # area under the curve


def test_quality_statistics_and_score_by_hand():
    import pyarrow as pa

    texts = ["The cat, the CAT sat. 12!", None, "", " \n ", "a a a a", "x### y | z\n", "ñandú über"]
    x = quality.statistics(pa.array(texts))
    assert np.isfinite(x).all() and np.array_equal(x[1], x[2])
    f = {name: x[:, k] for k, name in enumerate(quality.FEATURES)}
    share = lambda a, b: np.arcsin(np.sqrt(a / b))
    assert np.allclose(f["words"], np.log1p([6, 0, 0, 0, 4, 4, 2]))
    assert np.isclose(f["capitals"][0], share(4, 15)) and np.isclose(f["doubled_words"][4], share(3, 3))
    assert np.isclose(f["symbols"][5], share(4, 7)) and np.isclose(f["bare_marks"][5], share(1, 4)) and np.isclose(f["marked_words"][5], share(1, 4))
    assert np.isclose(f["sentence_ends"][0], share(2, 6)) and np.isclose(f["distinct_words"][0], np.log1p(5) / np.log1p(6))
    assert np.isclose(f["beyond_ascii"][6], share(6, 12))  # bytes

    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.standard_normal((400, d)) @ rng.standard_normal((d, d)) * (1 + y)[:, None] + y[:, None]
    n = np.array([(y == k).sum() for k in (0, 1)], float)
    mean = np.array([x[y == k].mean(axis=0) for k in (0, 1)])
    scatter = np.array([(x[y == k] - mean[k]).T @ (x[y == k] - mean[k]) for k in (0, 1)])
    model = quality.discriminant(n, mean, scatter)
    log = []
    for k in (0, 1):
        cov = (1 - quality.TO_POOLED) * scatter[k] / n[k] + quality.TO_POOLED * scatter.sum(axis=0) / 400
        cov = (1 - quality.TO_SCALE) * cov + quality.TO_SCALE * np.diag(np.diag(cov)) + quality.FLOOR * np.eye(d)
        gap = x - mean[k]
        log.append(np.log((n[k] + 0.5) / 401) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))), atol=1e-9)


def test_quality_on_odd_rows(spark):
    long = "Word another here. " * 40_000
    rows = [(1, None, "a"), (2, "", "b"), (3, long, "c"), (3, long, "d"), (None, "x y", "e"), (4, "### @@", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    for labels, same in ((none, True), (some, False), (some.filter("quality = 1"), True)):
        measured = quality.measure(docs)
        model = quality.learn(measured, labels)
        got = sorted(quality.score_quality(measured, model).collect(), key=lambda r: (r["doc_id"] or 99))
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
        assert not same or len({round(r["score"], 6) for r in got}) == 1
    assert got[0]["score"] == got[1]["score"] and got[2]["score"] == got[3]["score"]
    assert quality.score_quality(quality.measure(docs.filter("doc_id < 0")), model).collect() == []
