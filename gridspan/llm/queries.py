"""One query for each operator of this subpackage, over its whole table, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import ctw, iblt, lattice, packing, pieces, quality, quotes, secrets, sharding, simhash
from gridspan.llm.common import read


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(read(spark, sf_dir, "conversations"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return ctw.score(docs, number % 7 != 2).withColumnRenamed("id", "doc_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"))
    spans = F.col("secrets")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    base_text = F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256")
    return found.select(F.col("doc_id").cast("long"), *map(count, ("assign", "access", "hex")), base_text, secrets.spans_text(spans).alias("spans"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_editions(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def packed_digests(pieces_: DataFrame) -> DataFrame:
    return pieces_.select(
        F.col("id").alias("doc_id"), "start", F.expr("octet_length(ids) div 4").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(packing.pack(read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op7_sentencepiece_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("piece_bpe_32k.model")
    both = pieces.encode(read(spark, sf_dir, "documents"), path, decoded=True)
    text = F.coalesce("text", F.lit(""))
    return both.select(
        F.col("id").alias("doc_id"),
        F.expr("octet_length(ids) div 4").cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == text).alias("round_trip"),
    )


def op8_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_lattice_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = lattice.embedding_groups(read(spark, sf_dir, "embeddings"))
    return groups.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def bad_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, bad, abusive): labelled documents, those of poor quality or abusive ones being bad."""
    toxic = F.col("toxic") == 1
    return read(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | toxic).alias("bad"), toxic.alias("abusive"))


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), bad_labels(spark, sf_dir))
    return judged.select(F.col("doc_id").cast("long"), "votes", "weak_reject", "score", "keep")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quotation_linking,
        op2_context_tree,
        op3_secret_scan,
        op4_minimax_shards,
        op5_lookup_sketch,
        op6_hilbert_packing,
        op7_sentencepiece_trie,
        op8_anchor_simhash,
        op9_lattice_embeddings,
        op10_weak_quality,
    )
}


def _secret_sql() -> str:
    """Spans in DuckDB: the texts between matches and the matches themselves give every match's place."""
    parts, counts = [], []
    for rank, rule in enumerate(secrets.RULES):
        regex = (("(?i)" if rule.any_case else "") + rule.regex).replace("'", "''")
        tag = f"k{rank}"
        parts.append(
            f"SELECT row, {rank} AS rank, '{rule.kind}' AS kind, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(groups) AS part, unnest(range(len(hits))) AS n FROM ("
            f"SELECT row, regexp_split_to_array(t, '{regex}')[:-2] AS gaps, regexp_extract_all(t, '{regex}') AS hits, regexp_extract_all(t, '{regex}', {rule.group}) AS groups FROM docs) {tag}"
        )
        counts.append((rule.kind, rule.least))
    least = " ".join(f"WHEN '{k}' THEN {n}" for k, n in counts)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, rank ORDER BY n) AS e FROM matches
), spans AS (
  SELECT row, rank, kind, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE length(part) >= CASE kind {least} END
), texts AS (
  SELECT row, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS c,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY row
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN texts USING (row)
"""


_EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT id, id AS seen FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.seen = l.a
), least AS (SELECT id, min(seen) AS component FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, id = component AS kept
FROM least LEFT JOIN counts ON a = id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quotation_linking": quotes.SQL,
    "op3_secret_scan": _secret_sql(),
    "op9_lattice_embeddings": _EMBEDDING_SQL,
}
