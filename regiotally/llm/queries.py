"""The queries ``opN_<name>`` over whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from regiotally.llm import decision_list, fill_middle, id_planes, latent_leaks, merkle_audit, order_minhash, page_templates, piece_language, pruned_graph, pseudonyms, rows, secret_forest, segment_resampling, tree_bpe

#: The secret of the pseudonyms; a deployment passes its own.
KEY = "a key for tests"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rows.shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number and checksum of ids, read back from bit-plane files."""
    path = rows.shared_path(spark, "bit-planes")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_planes.write_planes(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), slices)
    return id_planes.read_documents(spark, path)


def op2_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_templates.main_text(table(spark, sf_dir, "pages"))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's score."""
    return secret_forest.scan(table(spark, sf_dir, "documents"))


def op4_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return latent_leaks.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def replicated(pages: DataFrame) -> DataFrame:
    """``pages`` with what a damaged replica holds of each: by the digest of the id, 1 page in 256 each lost, cut or altered.

    ``replica_length`` and ``replica_digest`` are null for a lost record. A page without an id is undamaged.
    """
    kind = F.coalesce(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2), F.lit(""))
    body = F.when(kind == "01", F.expr("substring(html, 1, length(html) - 1)")).when(kind == "02", F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    text = merkle_audit.record_text(F.col("url"), body)
    held = kind != "00"
    return pages.withColumns(
        {"replica_length": F.when(held, F.octet_length(text).cast("long")), "replica_digest": F.when(held, F.sha2(text.cast("binary"), 256))}
    )


def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a damaged replica of all pages differs from the original, found by descending both trees.

    Both copies lie at the offsets of the archive's index. Pages without an id and repeated ids are records of their own.
    """
    placed = rows.written(merkle_audit.leaves(replicated(table(spark, sf_dir, "pages")), "page_id", carried=["replica_length", "replica_digest"]), "replicas")
    own = placed.select("key", "offset", "length", "digest")
    replica = placed.filter("replica_digest is not null").select("key", "offset", F.col("replica_length").alias("length"), F.col("replica_digest").alias("digest"))
    found = merkle_audit.damage(merkle_audit.tree(own), merkle_audit.tree(replica))
    return found.select(F.col("key").alias("page_id"), "offset", "length", "status")


OP5_SQL = """
WITH records AS (
    SELECT page_id, strlen('WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: ') + strlen(coalesce(url, ''))
           + strlen('\r\nContent-Type: text/html\r\nContent-Length: ') + length(CAST(strlen(coalesce(html, '')) AS VARCHAR))
           + 8 + strlen(coalesce(html, '')) AS length, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS kind, html
    FROM pages
), placed AS (
    SELECT *, coalesce(sum(length) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM records
)
SELECT page_id, CAST(start AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, CASE WHEN kind = '00' THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE kind = '00' OR (kind IN ('01', '02') AND html <> '')
"""


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its class of near duplicates."""
    found = order_minhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = tree_bpe.encode_texts(table(spark, sf_dir, "documents"), ranks, pattern)
    return tree_bpe.digests(tree_bpe.decode_ids(encoded, ranks, pattern))


def op8_piece_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    trained = docs.filter(F.col("doc_id").isNotNull() & ~held_out)
    model = piece_language.learn(trained, public_tokenizers.path("piece_bpe_32k.model"))
    answer = piece_language.predicted(model, "text")
    return docs.select("doc_id", held_out.alias("held_out"), answer.alias("_answer")).select("doc_id", "held_out", "_answer.lang_pred", "_answer.score")


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, by rules learned from the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return decision_list.judged(docs, decision_list.learn(docs, table(spark, sf_dir, "labels")))


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, KEY)


def op11_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id is divisible by 100."""
    return pruned_graph.neighbours(table(spark, sf_dir, "embeddings"))


#: Exact neighbours; the beams of one small shard meet all of them.
OP11_SQL = """
WITH usable AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), measured AS (
    SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
    FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM measured QUALIFY rank <= 10
"""


def op12_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and its rank among those drawn."""
    return segment_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, and the text rebuilt from the output."""
    return fill_middle.digests(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex
    FROM documents
), drawn AS (
    SELECT doc_id, text, lines, len(lines) AS n,
           CAST('0x' || substr(hex, 1, 8) AS BIGINT) % (len(lines) + 1) AS a, CAST('0x' || substr(hex, 9, 8) AS BIGINT) % (len(lines) + 1) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR CAST('0x' || substr(hex, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
                WHEN CAST('0x' || substr(hex, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS (
    SELECT *, array_to_string(lines[1:least(a, b)], '') AS prefix, array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS middle,
           array_to_string(lines[greatest(a, b) + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


QUERIES = [op1_bit_planes, op2_page_templates, op3_secret_forest, op4_latent_leaks, op5_merkle_audit, op6_order_minhash, op7_tree_bpe, op8_piece_language, op9_decision_list, op10_feistel_pseudonyms, op11_pruned_graph, op12_segment_resampling, op13_fill_middle]


def oracles() -> dict[str, str]:
    return {"op5_merkle_audit": OP5_SQL, "op11_pruned_graph": OP11_SQL, "op13_fill_middle": OP13_SQL}
