"""The thin queries over this subpackage's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_ivfpq, bpe, knn_voronoi, langid, lm, near_dedup, packing, storage, substring_dedup, toxicity, warc


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(folds: int) -> Column:
    """crc32 of doc_id as text modulo ``folds``; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(_table(spark, sf_dir, "documents"), id_fold(5) != 1)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = langid.read_pieces(_tokenizer("piece_bpe_32k.model"))
    model = langid.train(docs.where(id_fold(4) != 2), pieces)
    return langid.predict(docs.withColumn("held_out", id_fold(4) == 2), model, carry=("held_out",))


def op7_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_voronoi.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs.where(id_fold(5) != 0), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.withColumn("held_out", id_fold(5) == 0), model, carry=("held_out",))


def op9_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_ivfpq.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_lm": op1_ngram_lm,
    "op2_bpe": op2_bpe,
    "op3_near_dedup": op3_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_langid": op6_langid,
    "op7_voronoi_knn": op7_voronoi_knn,
    "op8_toxicity": op8_toxicity,
    "op9_ivfpq": op9_ivfpq,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {
    "op3_near_dedup": """
        WITH RECURSIVE t AS (SELECT row_number() OVER () AS row_id, doc_id,
            coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []::VARCHAR[]) AS w FROM documents),
        s AS (SELECT row_id, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM t),
        e AS (SELECT row_id, unnest(g) AS g FROM s),
        p AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.row_id <> b.row_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN s a ON a.row_id = x JOIN s b ON b.row_id = y WHERE 100 * n >= 80 * (len(a.g) + len(b.g) - n)),
        r AS (SELECT row_id, doc_id FROM s UNION SELECT l.y, r.doc_id FROM r JOIN l ON l.x = r.row_id),
        c AS (SELECT row_id, min(doc_id) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (row_id)
    """,
    "op4_substring_dedup": """
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []::VARCHAR[]) AS w FROM documents),
        r AS (SELECT row_number() OVER () AS row_id, doc_id, w FROM d),
        p AS (SELECT row_id, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM r WHERE len(w) >= 50),
        h AS (SELECT row_id, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS win FROM p),
        m AS (SELECT row_id, i FROM (SELECT row_id, i, doc_id, min(doc_id) OVER (PARTITION BY win) AS first_doc FROM h)
              WHERE first_doc < doc_id OR (doc_id IS NULL AND first_doc IS NOT NULL)),
        c AS (SELECT DISTINCT row_id, unnest(range(i, i + 50)) AS i FROM m),
        g AS (SELECT row_id, list(i) AS gone FROM c GROUP BY row_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w
                   ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
        FROM r LEFT JOIN g USING (row_id)
    """,
    "op7_voronoi_knn": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN kept IS DISTINCT FROM page_id AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN kept IS DISTINCT FROM page_id THEN kept END AS refers_to
        FROM m
    """,
}
