"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, chat, codes, jaccard, language, licenses, mixing, neardup, neighbours, packing, separators, sharding, substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = licenses.train_licenses(licenses.sample_paragraphs(docs))
    return licenses.scan_licenses(docs, model)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.count_document_tokens(table(spark, sf_dir, "documents")).select("doc_id", "stream", "ordinal", "start", "n_tokens")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.in_fold(F.col("doc_id"))
    model = language.train_languages(docs.where(~held_out), key=F.col("doc_id"))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_similar(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return views.select("conv_id", "perspective", "piece", F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("train_spans"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_documents(mixing.by_length(table(spark, sf_dir, "documents")), importance_col="__importance")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_packing, op3_token_counts, op4_language_id, op5_ngram_jaccard_join, op6_chat_formatting, op7_embedding_near_dedup, op8_nearest_neighbours, op9_mixing, op10_sharding, op11_substring_dedup, op12_vector_codes, op13_token_alignment)}

#: Rounds of op12_vector_codes as SQL: each takes the codebooks of the one before.
ROUND = """
        a{k} AS MATERIALIZED (
            SELECT vec_id, label, p, v, c, d FROM (
                SELECT x.vec_id, x.label, x.p, x.v, b.c, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
                    row_number() OVER (PARTITION BY x.vec_id, x.p ORDER BY d, b.c) AS r
                FROM pieces x JOIN b{k} b ON x.p = b.p) WHERE r = 1),"""
NEXT = """
        m{n} AS (
            SELECT p, c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
                SELECT p, c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, unnest(range(1, len(v) + 1)) t(i) GROUP BY p, c, i) GROUP BY p, c),
        b{n} AS MATERIALIZED (SELECT b.p, b.c, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{n} m ON b.p = m.p AND b.c = m.c),"""

ORACLE_SQL = {
    "op11_substring_dedup": """
        WITH texts AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        windows AS MATERIALIZED (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM texts, unnest(range(1, len(w) - 48)) t(s)),
        first AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h),
        gone AS MATERIALIZED (SELECT DISTINCT doc_id, s + k AS p FROM windows JOIN first USING (h), unnest(range(50)) t(k) WHERE doc_id > f),
        kept AS (
            SELECT t.doc_id, count(*) AS n, string_agg(t.word, ' ' ORDER BY t.p) AS rest
            FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts) t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY t.doc_id)
        SELECT x.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
        FROM texts x LEFT JOIN kept k ON x.doc_id = k.doc_id""",
    "op12_vector_codes": """
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pieces AS MATERIALIZED (SELECT vec_id, label, p, w[p * (len(w) // 8) + 1 : (p + 1) * (len(w) // 8)] AS v FROM kept, unnest(range(8)) t(p)),
        b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, v FROM pieces WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),"""
    + "".join(ROUND.format(k=k) + NEXT.format(k=k, n=k + 1) for k in range(6)) + ROUND.format(k=6)
    + """
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS h FROM b6),
        found AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', c), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM found, books""",
    "op6_chat_formatting": """
        WITH turns AS (SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') AS role, replace(coalesce(text, ''), '<|', '< |') AS words FROM conversations),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, words) - 1 AS pos FROM turns),
        views AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
        seen AS (
            SELECT p.conv_id, perspective, CAST(pos // 256 AS BIGINT) AS piece, pos, role = perspective AS mine, words || chr(60) || '|end|>' || chr(10) AS body,
                CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head
            FROM placed p JOIN views v ON p.conv_id IS NOT DISTINCT FROM v.conv_id),
        ends AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, piece ORDER BY pos) AS BIGINT) AS stop FROM seen)
        SELECT conv_id, perspective, piece, count(*) AS n_turns, string_agg(head || body, '' ORDER BY pos) AS text,
            coalesce(string_agg((stop - length(body)) || ':' || length(body), ',' ORDER BY pos) FILTER (mine), '') AS train_spans
        FROM ends GROUP BY conv_id, perspective, piece""",
}
