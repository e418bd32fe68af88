"""Text queries next to brute force over whole tables, and defined results on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from voxtable.llm.decontamination import find_leaks, tile
from voxtable.llm.exact_dedup import exact_duplicates
from voxtable.llm.near_dedup import near_duplicates
from voxtable.llm.packing import pack
from voxtable.llm.pii import discover, find_personal_data
from voxtable.llm.recurrent_lm import score_texts
from voxtable.llm.secret_scan import find_secrets
from voxtable.llm.substring_dedup import repeated_spans, without_repeats
from voxtable.llm.tokens import tokenizer_path
from voxtable.llm.toxicity import Lexicon, context, learn, score_toxicity

LONG = "alpha beta " * 30_000
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (4, "one two"), (5, LONG), (6, LONG.upper()), (7, "naïve ünï " * 3), (None, "x y z")]


@pytest.fixture(scope="module")
def texts(sf):
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, 1, 2) for i, t in ODD], "doc_id long, text string, lang string, kind int, start int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id < 0")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encode(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return {k: [*e.ids, 0] for (k, _), e in zip(texts.items(), t.encode_batch(list(texts.values()), add_special_tokens=False))}


def test_token_files_hold_the_library_ids(spark, sf, texts):
    want, start = {}, 0
    for k, ids in sorted(encode("byte_bpe_50k.json", texts).items()):
        want[k] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in entry.queries()["op6_token_files"](spark, sf).collect()}
    assert got == want


def check_packing(rows, ids):
    fill, seen = defaultdict(list), set()
    for r in rows:
        part = ids[r["doc_id"]][r["start"]: r["start"] + 2048]
        assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * r["piece"], len(part), crc(part))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        seen.add((r["doc_id"], r["piece"]))
    assert len(seen) == len(rows) == sum(-(-len(v) // 2048) for v in ids.values())
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(fill)


def test_packing_is_gapless_and_tight(spark, sf, texts):
    ids = encode("word_bpe_49k.json", texts)
    used = check_packing(entry.queries()["op7_best_fit_packing"](spark, sf).collect(), ids)
    assert used <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_personal(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15])


@pytest.mark.parametrize("query, kinds, find", [
    ("op8_secret_scan", ("assign", "access", "hex"), base_secrets), ("op10_pii", ("email", "ip", "card", "phone"), base_personal)])
def test_base_spans(spark, sf, texts, query, kinds, find):
    got = {r["doc_id"]: r for r in entry.queries()[query](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        spans = find(t)
        line = [f"{kinds[r]}:{a}:{z}" for a, r, z in spans]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert set(line) <= set(got[k]["spans"].split(","))
        assert [got[k][f"n_{x}"] for x in kinds] == [sum(r == i for _, r, _ in spans) for i in range(len(kinds))]


TRICKY = ["a@b.c_d@e.f.g", "x" * 5000, "1.2.3.4.5 0300.001.2.3 256.1.1.1", "4111 1111-1111 1111", "+1 (2) +12 +1 555 666 7777 é+4912345678901", "1" * 9000,
          "é a@b.co", "a@b a@b..c ..@a.b"]


def test_base_spans_on_tricky_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for r in find_personal_data(docs).collect():
        line = [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{z}" for a, k, z in base_personal(TRICKY[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(line).encode()).hexdigest(), TRICKY[r["doc_id"]][:50]


def test_context_discovers_identifiers(spark):
    seeds = [(i, f"please write to user{i}@mail.example.com today") for i in range(60)]
    docs = spark.createDataFrame([*seeds, (100, "please write to kx-7741 today"), (101, "the year is 2024 again")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in find_personal_data(docs).collect()}
    assert got[100] == "id:16:23" and got[101] == ""


ISSUES = {100: ("call me at kx-7741 now", "id:11:18"), 101: ("call me\tat\nKX-77412", "id:11:19"), 102: ("call me at K1 B67890", "id:11:13,id:14:20"),
          103: (f"call {'m' * 50} at {'k' * 70}-1{'2' * 130}", ""), 104: (f"ask me at {'k' * 70}-1{'2' * 130}.", "id:10:212"), 105: ("7", "")}


def test_phones_with_blanks_find_identifiers(spark):
    seeds = [(i, f"call me at +1 ({i:03d}) 555-77{i:02d} now") for i in range(60)]
    docs = spark.createDataFrame([*seeds, *((k, t) for k, (t, _) in ISSUES.items())], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in find_personal_data(docs).collect()}
    assert got[0] == "phone:11:28"
    assert {k: got[k] for k in ISSUES} == {k: want for k, (_, want) in ISSUES.items()}


def test_identifiers_that_begin_a_text_or_line(spark):
    seeds = [(i, f"user{i}@mail.example.com\nid:\nuser{i}@post.example.com") for i in range(60)]
    docs = spark.createDataFrame([*seeds, (100, "KX-77412"), (101, "id:\nKX-77413"), (102, "x KX-77414")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in find_personal_data(docs).collect()}
    assert (got[100], got[101], got[102]) == ("id:0:8", "id:4:12", "")


def test_repeated_ids_are_read_as_their_greatest_text(spark):
    docs = spark.createDataFrame([(1, "b x@y.org"), (1, "a longer text 1.2.3.4"), (1, "b x@y.org"), (2, "z")], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in find_personal_data(docs).collect()} == {1: "email:2:9", 2: ""}


def test_seeds_take_their_candidates(spark):
    cand = spark.createDataFrame([(1, s, e, f"i{s}", "at") for s, e in ((0, 5), (5, 9), (12, 20), (30, 33))],
                                 "row long, start int, end int, instance string, pattern string")
    seeds = spark.createDataFrame([(1, s, s + 2) for s in range(100, 300, 4)] + [(1, 3, 5), (1, 8, 40)], "row long, start long, end long")
    assert not discover(cand, seeds).collect()  # too little support
    rows = [(i, 0, 5, f"n{i}", "at") for i in range(20)] + [(50, 0, 5, "new", "at"), (51, 5, 9, "late", "at")]
    cand = spark.createDataFrame(rows, cand.schema)
    seeds = spark.createDataFrame([(i, 4, 8) for i in range(20)] + [(50, 5, 6), (51, 1, 5)], seeds.schema)
    assert sorted(tuple(r) for r in discover(cand, seeds).collect()) == [(50, 0, 5), (51, 5, 9)]


def test_lm_counts_and_base(spark, sf, texts):
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    count = Counter(w for k, t in texts.items() if not held[k] for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    rows = {r["doc_id"]: r for r in entry.queries()["op5_recurrent_lm"](spark, sf).collect()}
    for k, t in texts.items():
        mine, r = [*words(t), None], rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(mine), sum(count[w] > 0 for w in mine), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in mine), rel=1e-9)
        assert r["score"] < 0
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_trains_on_texts_of_any_id(spark):
    text = "tick tock " * 800
    docs = spark.range(200).selectExpr("id as doc_id", f"'{text}' as text").filter("pmod(xxhash64(doc_id), 16) <> 0").limit(40).repartition(2)
    rows = score_texts(docs, docs).collect()
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows)


def test_leaks_are_the_items_inside(spark, sf, texts):
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    plain = lambda t: " " + " ".join(w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w) + " "
    whole = {(k, i) for k, t in texts.items() for i, x in items if plain(x) in plain(t)}
    got = {(r["doc_id"], r["item_id"]) for r in entry.queries()["op4_decontamination"](spark, sf).collect()}
    assert whole <= got


def test_tiles_catch_reordered_passages():
    item = np.arange(1, 41, dtype=np.uint64)
    text = np.concatenate((item[20:], np.full(3, 99, np.uint64), item[:20]))
    assert sorted(tile(text, item)) == [(0, 20, 20), (23, 0, 20)]
    assert tile(item[:4], item) == []


def test_repeated_passage_is_cut_once(spark):
    rng = np.random.default_rng(3)
    new = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    passage = new(60)
    rows = [(i, f"{new(30)} {passage} {new(30)}") for i in range(8)] + [(9, new(200)), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = repeated_spans(docs)
    got = {r["doc_id"]: r for r in spans.collect()}
    assert set(got) == set(range(1, 8)) and all(r["first_docs"] == [0] for r in got.values())
    left = {r["doc_id"]: r["text"] for r in without_repeats(docs, spans).collect()}
    assert left[0] == rows[0][1] and left[9] == rows[8][1] and all(len(left[i]) < 620 for i in range(1, 8))


def test_toxicity_on_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in entry.queries()["op2_toxicity"](spark, big).collect()}
    labels = duckdb.sql(f"select doc_id, toxic from '{big}/labels.parquet'").fetchall()
    held = [(rows[k], y) for k, y in labels if k in rows and rows[k]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    hit = sum(r["predicted"] and y for r, y in held)
    assert hit >= 0.6 * sum(y for _, y in held) and sum(r["predicted"] and not y for r, y in held) <= 0.02 * len(held)


def test_misspelled_and_quoted_terms():
    lexicon = Lexicon(["stupid", "lowei*"])
    assert [lexicon.meet(w) for w in ("stupid,", "stupd", "stuupid", "loweient", "study", "")] == [1, 2, 2, 1, 0, 0]
    assert context("you are stupid".split(), 2) > 0 > context('he said "stupid" once'.split(), 2)


@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op9_exact_dedup"])
def test_dedup_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_awkward_rows(odd):
    exact = {r["doc_id"]: r for r in exact_duplicates(odd).collect()}
    assert exact[1]["keep_id"] == 2 and exact[5]["keep_id"] == 6 and exact[4]["group_size"] == 2 and None not in exact
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(odd).collect()}
    assert near[1] == (0, 1) and near[3] == (0, 3) and near[4] == (1, 4) and near[6] == (2, 5)
    assert len(pack(odd, tokenizer_path("word_bpe_49k.json"), False).filter("doc_id < 5").collect()) == 5
    assert find_secrets(odd).count() == len(ODD)
    assert {r["doc_id"] for r in find_personal_data(odd).collect()} == {1, 2, 3, 4, 5, 6, 7}
    lm = score_texts(odd, odd).collect()
    assert len(lm) == 8 and all(math.isfinite(r["score"]) for r in lm)
    assert {r["doc_id"] for r in repeated_spans(odd).collect()} <= {5, 6}
    terms, weights = learn(odd, odd.selectExpr("doc_id", "cast(null as int) as toxic"))
    assert score_toxicity(odd, terms, weights).columns == [*odd.columns, "score"]


def test_empty_tables(none):
    labels = none.selectExpr("doc_id", "1 as toxic")
    items = none.selectExpr("doc_id as item_id", "text")
    for out in (exact_duplicates(none), near_duplicates(none), pack(none, tokenizer_path("word_bpe_49k.json"), False), find_secrets(none),
                find_personal_data(none), score_texts(none, none), repeated_spans(none), find_leaks(none, items), score_toxicity(none, *learn(none, labels))):
        assert out.count() == 0


def test_pipeline_stages(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, kept, sf), "test")
        assert after.columns == docs.columns and after.count() <= kept.count()
        kept = after
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    sets = [frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else None) for w in map(words, left.values())]
    sets = [s for s in sets if s]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(a & b)
            assert 100 * both < 75 * (len(a) + len(b) - both)
    check_packing(corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect(), encode("word_bpe_49k.json", left))
