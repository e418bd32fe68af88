"""The recurrent language model: gradients by differences, likelihood by a plain loop, probabilities that sum to 1."""

import numpy as np
import pytest

import __spark_entry__ as entry
from voxtable.llm import recurrent_lm as lm


@pytest.fixture(scope="module")
def weights():
    mass = np.random.default_rng(1).exponential(1, lm.CELLS) + 1e-3
    w = lm.first_weights(mass)
    rng = np.random.default_rng(2)
    return {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in w.items()}


def plain(w, cells):
    """Log probability of one text, word by word."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    h, before, total, d = np.zeros(lm.HIDDEN), lm.END, 0.0, lm.HIDDEN
    for cell in cells:
        x, u = w["e"][before] @ w["wx"] + w["b"], h @ w["wh"]
        z, r = sig(x[:d] + u[:d]), sig(x[d: 2 * d] + u[d: 2 * d])
        n = np.tanh(x[2 * d:] + r * u[2 * d:])
        h = (1 - z) * n + z * h
        k, place = divmod(int(cell), lm.SIDE)
        total += soft(h @ w["oc"] + w["bc"])[k] + soft(h @ w["op"][k] + w["bp"][k])[place]
        before = cell
    return total


def some_texts(seed=0, lengths=(1, 5, 40, 33, 32, 200, 7, 1, 64)):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, lm.CELLS, n).astype(np.int32) for n in lengths]


def test_lanes_hold_every_text_once():
    texts = some_texts(3, (3, 400, 7, 1, 90, 90, 2))
    lanes = lm.deal(texts, 3)
    seen = [[] for _ in texts]
    for j in range(lanes.cells.shape[1]):
        for t in np.flatnonzero(lanes.cells[:, j] >= 0):
            assert lanes.starts[t, j] == (not seen[lanes.owner[t, j]])
            seen[lanes.owner[t, j]].append(lanes.cells[t, j])
    assert all(np.array_equal(a, b) for a, b in zip(seen, texts)) and len(lanes.cells) == 400


def test_likelihood_is_that_of_a_plain_loop(weights):
    texts = some_texts()
    want = [plain(weights, t) for t in texts]
    assert lm.log_likelihood(weights, texts) == pytest.approx(want, rel=1e-5)
    small = {k: v.astype(np.float32) for k, v in weights.items()}
    assert lm.log_likelihood(small, texts * 40) == pytest.approx(want * 40, rel=1e-3)  # lanes hold several texts each
    assert lm.log_likelihood(weights, []).tolist() == []


def test_gradients_by_finite_differences(weights):
    texts = some_texts(5, (30, 9, 12, 25))
    lanes = lm.deal(texts, 2)
    inputs, targets, starts, _ = next(lanes.windows())
    h = np.random.default_rng(4).standard_normal((inputs.shape[1], lm.HIDDEN)) * 0.1
    starts = starts.copy()
    starts[0] = False  # a state carried into the window

    def loss(w):
        states, _ = lm._run(w, inputs, starts, h, False)
        real = targets >= 0
        s, t, total = states[real].astype(float), targets[real], 0.0
        for row, cell in zip(s, t):
            k, place = divmod(int(cell), lm.SIDE)
            a, b = row @ w["oc"] + w["bc"], row @ w["op"][k] + w["bp"][k]
            total -= a[k] - np.log(np.exp(a).sum()) + b[place] - np.log(np.exp(b).sum())
        return total

    g, _, n = lm.gradients(weights, inputs, targets, starts, h)
    assert n == int((targets >= 0).sum())
    rng, step = np.random.default_rng(6), 2e-2
    for k, v in weights.items():
        hot = np.flatnonzero(np.abs(g[k]) > 0.2 * np.abs(g[k]).max())
        for at in rng.choice(hot, 3):
            moved = []
            for sign in (1, -1):
                other = {n: x.copy() for n, x in weights.items()}
                other[k].flat[at] += sign * step
                moved.append(loss(other))
            assert (moved[0] - moved[1]) / (2 * step) == pytest.approx(g[k].flat[at], rel=0.03, abs=2e-3), (k, at)


def test_probabilities_of_all_words_sum_to_one(spark, weights, monkeypatch):
    monkeypatch.setattr(lm, "CARRIED", 4500)
    rng = np.random.default_rng(9)
    names = rng.integers(-(1 << 62), 1 << 62, 6000)
    counts = spark.createDataFrame([(int(w), int(c)) for w, c in zip(names, rng.integers(1, 5, 6000) + 100 * (np.arange(6000) < 9))], "word long, c long")
    v, known, spare = lm.learn_vocabulary(counts, 50)
    joined = known.collect()
    assert len(joined) + len(v.heads) == 6000 == v.kinds - 1 and v.tokens == 50 + sum(r["c"] for r in counts.collect())
    state = np.full(lm.HIDDEN, 0.3)
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    cell = (soft(state @ weights["oc"] + weights["bc"])[:, None] * np.array([soft(state @ weights["op"][k] + weights["bp"][k]) for k in range(lm.SIDE)])).ravel()
    assert cell.sum() == pytest.approx(1)
    of, place = v.cells(np.array([r["word"] for r in joined]).view(np.uint64))
    assert (place < 0).all() and (of >= lm.OWNED).all()
    share = np.zeros(lm.CELLS)
    share[lm.END] = 1
    np.add.at(share, of, [10 ** r["share"] for r in joined])
    of, place = v.cells(v.heads)
    assert np.array_equal(place, np.arange(4500))
    np.add.at(share, of, 10 ** v.share_of_head)
    for k, s in spare.items():
        share[k] += 10**s
    used = [*range(lm.OWNED), *spare]
    assert len(spare) > 900 and share[used] == pytest.approx(1) and (cell * share)[used].sum() <= 1 + 1e-9


def test_gain_over_base_on_held_out_texts(spark, sf):
    rows = entry.queries()["op5_recurrent_lm"](spark, sf.replace("sf0.001", "sf0.01")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)


def test_order_of_words_is_learnt(spark):
    """Words of equal counts whose order tells the next one: a model of single words cannot gain."""
    rng = np.random.default_rng(0)
    after = rng.permutation(40)

    def text():
        w, out = rng.integers(40), []
        for _ in range(300):
            out.append(f"word{w}")
            w = after[w]
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string").coalesce(2)
    rows = lm.score_texts(docs, docs.filter("doc_id % 5 <> 1")).filter("doc_id % 5 = 1").collect()
    assert sum(r["score"] for r in rows) > 0.7 * sum(r["base_score"] for r in rows)


def test_odd_rows(spark):
    long = "alpha beta gamma " * 20_000
    rows = [(1, None), (2, ""), (2, ""), (3, long), (3, "alpha new"), (None, "x"), (4, " \n"), (5, "UNSEEN words")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, key int, score double")
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"]) for r in lm.score_texts(docs, docs.filter("doc_id = 3")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 3, 3), (3, 60_001, 60_001), (4, 1, 1), (5, 3, 1)]
    none = lm.score_texts(docs, docs.filter("doc_id < 0")).collect()
    assert len(none) == 7 and all(r["train_tokens"] == r["n_known"] == 0 and np.isfinite(r["score"]) for r in none)
    assert lm.score_texts(docs.filter("doc_id < 0"), docs).collect() == []
