"""Toxic texts: a learned lexicon in a trie, met by Levenshtein automata, with context windows around each hit.

The lexicon holds words, and stems (a word that begins so), that labelled toxic texts use far more often than
others.  Every word of a text is run through its Levenshtein automaton along the trie, so a misspelled term is
found in one walk.  A hit's window of words tells abuse from quotation.  Texts are scored by a logistic model
over counts of abusive, quoted and misspelled hits, fitted on the same labelled texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta

LABELLED = 20_000  # most labelled texts the lexicon and the model are fitted on, by smallest hash of the id
TERMS = 4_000  # most lexicon entries
LEAST_TEXTS, LEAST_WEIGHT = 5, 9.5  # texts a term must mark, and log odds times their square root
STEM = range(4, 7)  # lengths of stems
WINDOW = 4  # words on each side of a hit
FUZZY_FROM = 5  # shorter terms must be met exactly
TOP = 3  # counts of hits above this are alike
CUT = 0.7
MEMO = 400_000

# fixed values: marks of quotation, words of report, and words of address in four languages
QUOTES = "\"“”„«»‘’'"
REPORT = frozenset("said says wrote writes called calls quoted quote word term sagte schrieb nannte wort dijo escribió "
                   "llamó palabra dit écrit appelé mot".split())
ADDRESS = frozenset("you your you're u ur du dich dir ihr tú te tu usted vous toi ton".split())
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…¿¡"


def lower(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Lexicon:
    """Trie over terms and stems; ``meet`` runs a word's Levenshtein automaton of one edit along it."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t.rstrip("*"):
                node = node.setdefault(c, {})
            node["stem" if t.endswith("*") else "end"] = True
        self.memo: dict[str, int] = {}

    @classmethod
    def of_worker(cls, terms: list[str]) -> Lexicon:
        """One lexicon and one memory of met words per Python worker."""
        cache = ta.worker_cache("toxicity")
        if cache.get("terms") != terms:
            cache.update(terms=terms, lexicon=cls(terms))
        return cache["lexicon"]

    def meet(self, token: str) -> int:
        """0: no term, 1: a term as it is, 2: a term with one edit."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[token] = self._meet(token.strip(_EDGE))
        return got

    def _meet(self, word: str) -> int:
        n, best = len(word), 0
        # a state of the automaton is (letters read, edits made); it moves together with a node of the trie
        stack, seen = [(self.root, 0, 0)] if n else [], set()
        while stack:
            node, i, edits = stack.pop()
            key = (id(node), i, edits)
            if key in seen:
                continue
            seen.add(key)
            if not edits and "stem" in node:
                return 1
            if i == n and "end" in node:
                if not edits:
                    return 1
                best = 2
            if i < n:
                child = node.get(word[i])
                if child is not None:
                    stack.append((child, i + 1, edits))
            if not edits and n >= FUZZY_FROM:
                if i < n:
                    stack.append((node, i + 1, 1))
                for c, child in node.items():
                    if len(c) == 1:
                        stack.append((child, i, 1))
                        if i < n and c != word[i]:
                            stack.append((child, i + 1, 1))
        return best


def context(words: list[str], at: int) -> float:
    """Above 0: said to somebody; below 0: quoted or reported."""
    around = words[max(0, at - WINDOW): at] + words[at + 1: at + 1 + WINDOW]
    score = 0.5
    if words[at][0] in QUOTES and words[at].rstrip(".,;:!?")[-1:] in tuple(QUOTES):
        score -= 1.0
    else:
        before = sum(w[0] in QUOTES for w in words[max(0, at - WINDOW): at + 1])
        after = sum(w.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for w in words[at: at + 1 + WINDOW])
        score -= 1.0 if before and after else 0.0
    bare = [w.strip(_EDGE) for w in around]
    return score - 0.4 * any(w in REPORT for w in bare) + 0.4 * any(w in ADDRESS for w in bare)


def features(lexicon: Lexicon, text: str | None) -> tuple[int, int, int]:
    """Abusive, quoted and misspelled hits, each counted up to TOP."""
    words = lower(text)
    kinds = {w: k for w in set(words) if (k := lexicon.meet(w))}
    if not kinds:
        return 0, 0, 0
    abuse = quoted = fuzzy = 0
    for at, w in enumerate(words):
        k = kinds.get(w)
        if k == 2:
            fuzzy += 1
        elif k and context(words, at) > 0:
            abuse += 1
        elif k:
            quoted += 1
    return min(abuse, TOP), min(quoted, TOP), min(fuzzy, TOP)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (term, bad, good): texts per term and label, added up as far as one task sees them."""
    bad, good = Counter(), Counter()

    def flush():
        terms = list(bad.keys() | good.keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([bad[t] for t in terms], pa.int64()), pa.array([good[t] for t in terms], pa.int64())],
            names=["term", "bad", "good"])
        bad.clear()
        good.clear()
        return out

    for b in ta.row_slices(batches, 0):
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = {w.strip(_EDGE) for w in set(lower(text))}
            terms = {w for w in words if w} | {w[:k] + "*" for w in words for k in STEM if len(w) > k}
            (bad if toxic else good).update(terms)
            if len(bad) + len(good) > 500_000:
                yield flush()
    if bad or good:
        yield flush()


def learn_lexicon(labelled: DataFrame) -> list[str]:
    """Terms from (text, toxic); copies of a text count once."""
    totals = {bool(r["toxic"]): r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    counts = labelled.mapInArrow(_counted, "term string, bad long, good long").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    best = (
        counts.filter(F.col("bad") >= LEAST_TEXTS).withColumn("weight", odds * F.sqrt("bad")).filter(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc("weight"), "term").limit(TERMS)
    )
    return [r["term"] for r in best.select("term").collect()]


def _design(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(float)
    return np.column_stack((np.ones(len(x)), x, x > 0))


def fit(table: list[tuple[tuple[int, int, int], int, int]]) -> np.ndarray:
    """Logistic weights by Newton steps with a ridge; ``table`` has a row (features, toxic, others) per distinct features."""
    x = _design(np.array([t[0] for t in table], dtype=float).reshape(-1, 3))
    bad, good = np.array([t[1] for t in table], float), np.array([t[2] for t in table], float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.3] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        n = bad + good
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, x.T @ (bad - n * p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def probability(weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(found) @ weights, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          most: int = LABELLED) -> tuple[list[str], np.ndarray]:
    """(terms, weights) from labelled texts; without any, no terms and even odds.

    Of the labelled ids the ``most`` with the smallest hashes are used.  Null labels and ids are left out.
    """
    ids = (
        labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col).cast("int") > 0).alias("toxic"))
        .filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(most)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    labelled = texts.join(ids, "id").dropDuplicates(["text", "toxic"]).select("text", "toxic").persist()
    try:
        terms = learn_lexicon(labelled)
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon.of_worker(terms)
            for b in ta.row_slices(batches, 0):
                got = [features(lexicon, t) for t in b.column(0).to_pylist()]
                cols = zip(*got) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int32()) for c in cols], b.column(1)], names=["a", "q", "f", "toxic"])

        # at most (TOP + 1) ** 3 rows
        seen = labelled.mapInArrow(found, "a int, q int, f int, toxic boolean").groupBy("a", "q", "f").agg(
            F.sum(F.col("toxic").cast("long")).alias("bad"), F.sum((~F.col("toxic")).cast("long")).alias("good")).collect()
    finally:
        labelled.unpersist()
    return terms, fit([((r["a"], r["q"], r["f"]), r["bad"], r["good"]) for r in seen]) if seen else np.zeros(7)


def score_toxicity(docs: DataFrame, terms: list[str], weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: 0 to 1, higher when the text is likelier toxic.

    Null and empty texts have no hits and get the score of such texts.  Rows that repeat are scored alike; an
    input column of the name ``out`` is replaced.
    """
    schema = docs.drop(out).withColumn(out, F.lit(0.0)).schema
    at = [c for c in docs.columns if c != out].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon.of_worker(terms)
        for b in ta.row_slices(batches, at):
            got = np.array([features(lexicon, t) for t in b.column(at).to_pylist()], dtype=float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probability(weights, got))], names=[*b.schema.names, out])

    return docs.drop(out).mapInArrow(run, schema)
