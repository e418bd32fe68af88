"""Registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .decontamination import find_leaks
from .exact_dedup import exact_duplicates
from .merkle import audit
from .near_dedup import near_duplicates
from .packing import pack
from .pii import find_personal_data
from .quality import CUT as QUALITY_CUT, learn as learn_quality, measure, score_quality
from .recurrent_lm import score_texts
from .secret_scan import BASE as SECRET_BASE, digest, find_secrets
from .substring_dedup import repeated_spans
from .token_files import read_token_files, write_token_files
from .tokens import tokenizer_path
from .toxicity import CUT, learn, score_toxicity
from .whitening import whiten


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"


# CRC-32 of a decimal number: one step per digit, in it one per bit
CRC = """xor(list_reduce(list_prepend(4294967295, [ascii(c)::BIGINT FOR c IN string_split({0}, '')]),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
        lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf))


def op1_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf))


def fold(parts: int):
    """Remainder of the id's crc32, which tells held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    terms, weights = learn(docs, labels.filter(fold(3) != 1))
    scored = score_toxicity(docs.select("doc_id", "text"), terms, weights)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_spans(documents(spark, sf))


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op5_recurrent_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    scored = score_texts(docs, docs.filter(fold(5) != 1))
    return scored.withColumn("held_out", fold(5) == 1).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    manifest = write_token_files(
        documents(spark, sf), folder, tokenizer_path("byte_bpe_50k.json"), blank_in_word=True, vocabulary=50_257)
    return read_token_files(spark, folder, manifest).withColumnRenamed("id", "doc_id")


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(documents(spark, sf), tokenizer_path("word_bpe_49k.json"), blank_in_word=False)


def op8_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return digest(find_secrets(documents(spark, sf)), tuple(r.kind for r in SECRET_BASE))


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    return find_personal_data(documents(spark, sf))


def op11_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf}/embeddings.parquet"), components=4)


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return audit(documents(spark, sf))


def op13_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    measured = measure(docs.select("doc_id", "text"))
    scored = score_quality(measured, learn_quality(measured, labels.filter(fold(5) != 0)))
    return scored.select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_recurrent_lm": op5_recurrent_lm,
    "op6_token_files": op6_token_files,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii": op10_pii,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality": op13_quality,
}

ORACLES = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        m AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, doc_id = low AS kept
        FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n USING (doc_id)""",
    "op9_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {LOWER} AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM t JOIN g USING (body)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, {_leaf('text')} AS leaf,
                CASE WHEN {CRC.format('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                    ELSE {_leaf('text')} END AS changed
            FROM documents),
        l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM d),
        up AS (
            SELECT 0 AS level, lang, pos AS idx, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM l
            UNION ALL
            SELECT level + 1, lang, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8
            FROM up WHERE n > 1 GROUP BY level, lang, idx // 8, n),
        s AS (
            SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM up WHERE n = 1),
        top AS (
            SELECT 0 AS level, pos AS idx, subroot AS digest, count(*) OVER () AS n FROM s
            UNION ALL
            SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8
            FROM top WHERE n > 1 GROUP BY level, idx // 8, n),
        around AS (
            SELECT a.level, a.lang, a.idx,
                coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lo,
                coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS hi
            FROM up a JOIN up b ON a.level = b.level AND a.lang IS NOT DISTINCT FROM b.lang AND a.idx // 8 = b.idx // 8
            WHERE a.n > 1 GROUP BY ALL),
        above AS (
            SELECT a.level, a.idx,
                coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lo,
                coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS hi
            FROM top a JOIN top b ON a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL),
        path AS (
            SELECT doc_id, level, lo, hi FROM l JOIN around a
            ON a.lang IS NOT DISTINCT FROM l.lang AND a.idx = l.pos // (8 ** a.level)::BIGINT
            UNION ALL
            SELECT doc_id, 1000 + level, lo, hi FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang
            JOIN above o ON o.idx = s.pos // (8 ** o.level)::BIGINT),
        paths AS (SELECT doc_id, list({{'lo': lo, 'hi': hi}} ORDER BY level) AS p FROM path GROUP BY doc_id)
        SELECT l.doc_id, leaf, subroot, r.digest AS root,
            sha256(coalesce(array_to_string([x.lo || x.hi FOR x IN p], ''), '')) AS proof_sha256,
            coalesce(list_reduce(list_prepend({{'lo': '', 'hi': changed}}, p),
                lambda acc, x: {{'lo': '', 'hi': sha256(x.lo || acc.hi || x.hi)}}).hi, changed) AS folded_root,
            folded_root = r.digest AS verified
        FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top r ON r.n = 1 LEFT JOIN paths USING (doc_id)""",
}
