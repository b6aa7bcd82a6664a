"""The registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_documents(spark, sf_dir), tokenizer_path())


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .class_lm import score_documents

    return score_documents(read_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(read_documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, secret_spans

    return digest(secret_spans(read_documents(spark, sf_dir)))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(read_documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_documents(spark, sf_dir).select("doc_id", "source"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import resample

    return resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")))
    found = identify(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.expr("CAST(size(spans) AS LONG)").alias("n_spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(read_documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_ngram_jaccard_join, op3_class_lm, op4_exact_dedup, op5_mix_sources, op6_quality_classifier, op7_secret_scan, op8_language_id, op9_line_dedup, op10_vector_search)
}

#: Exact set-similarity join over the lines of ``source``; leaves the view ``deduped``.
LINE_DEDUP = r"""
    WITH src AS (SELECT * FROM {source}),
    ln AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS t FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM src)),
    wd AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D]+'), lambda w: w != '')) AS ws FROM ln),
    tok AS (SELECT doc_id, line, len(ws) AS n, unnest(ws) AS w FROM wd WHERE len(ws) > 0),
    df AS (SELECT w, count(*) AS c FROM tok GROUP BY w),
    ord AS (SELECT tok.*, row_number() OVER (PARTITION BY doc_id, line ORDER BY c, w) AS p FROM tok JOIN df USING (w)),
    pre AS (SELECT * FROM ord WHERE p <= n - ceil(n * 80 / 100) + 1),
    cand AS (SELECT DISTINCT b.doc_id AS d, b.line AS l, a.doc_id AS d0, a.line AS l0
             FROM pre a JOIN pre b ON a.w = b.w AND (a.doc_id, a.line) < (b.doc_id, b.line) AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    sim AS (SELECT c.d, c.l, len(x.ws) AS nx, len(y.ws) AS ny, len(list_intersect(x.ws, y.ws)) AS k
            FROM cand c JOIN wd x ON x.doc_id = c.d AND x.line = c.l JOIN wd y ON y.doc_id = c.d0 AND y.line = c.l0),
    gone AS (SELECT DISTINCT d AS doc_id, l AS line FROM sim WHERE 100 * k >= 80 * (nx + ny - k)),
    left_ AS (SELECT ln.doc_id, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (WHERE g.line IS NULL), '') AS text, count(*) AS n_lines, count(g.line) AS n_removed
              FROM ln LEFT JOIN gone g USING (doc_id, line) GROUP BY ln.doc_id),
    deduped AS (SELECT s.* REPLACE (CASE WHEN l.n_removed > 0 THEN l.text ELSE s.text END AS text), coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_removed, 0) AS n_removed
                FROM src s LEFT JOIN left_ l USING (doc_id))"""

ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)""",
    "op9_line_dedup": LINE_DEDUP.format(source="documents") + " SELECT doc_id, text, n_lines, n_removed FROM deduped",
}
