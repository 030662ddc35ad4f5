"""The registered queries of this package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import chat, lattice, merkle, minhash, packing, periods, quality, ring, secrets, suffixes, token_count, toxicity, vectors
from rankfold.llm.common import table

#: Production parameters.
PACK_VOCABULARY = "byte_bpe_50k.json"
SCAN_VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"
WINDOW = 1024
SHARDS = 40


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chat(turns.withColumn("parts", chat.text_parts(F.col("text")))))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_VOCABULARY), WINDOW)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold_percent=85)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path(SCAN_VOCABULARY))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    proofs = merkle.climb(merkle.build(docs, merkle.tamper_every_fifth(docs)))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


def op12_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(table(spark, sf_dir, "documents"), plant=periods.planted)


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_quality_rules, op3_packing, op4_sentencepiece, op5_suffix_array, op6_token_count, op7_minhash,
    op8_secret_scan, op9_embedding_neardup, op10_toxicity, op11_merkle_manifest, op12_hash_ring, op13_periodic_runs)}


def _chat_sql() -> str:
    # < or [ before a control string: RE2 has no look-ahead, so each string is named
    def escaped(x):
        x = f"replace({x}, '\\', '\\\\')"
        for s in ("<|", "<s>", "</s>", "[INST]", "[/INST]"):
            x = f"replace({x}, '{s}', '{s[0]}\\{s[1:]}')"
        return x
    marks = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum({marks} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""


#: All pairs of rows, whose links are then followed from each row; a path carries its rows once (UNION).
_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e)
    AND list_bool_and(list_transform(e, lambda x: isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
link AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS i, vec_id AS j FROM v
  UNION SELECT r.i, l.j FROM reach r JOIN link l ON l.i = r.j),
least AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i),
degree AS (SELECT i, count(*) AS n FROM link GROUP BY i)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN least c ON c.i = v.vec_id LEFT JOIN degree d ON d.i = v.vec_id"""

#: Shingle sets, all pairs that share a shingle, links followed from each row.
_MINHASH_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
size AS (SELECT doc_id, len(s) AS n FROM sets),
item AS (SELECT doc_id, md5_number(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM sets)),
pair AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM item a JOIN item b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (
  SELECT i, j FROM pair JOIN size p ON p.doc_id = i JOIN size q ON q.doc_id = j WHERE 100 * c >= 85 * (p.n + q.n - c)),
link AS (SELECT i, j FROM near UNION ALL SELECT j, i FROM near),
reach AS (
  SELECT doc_id AS i, doc_id AS j FROM sets
  UNION SELECT r.i, l.j FROM reach r JOIN link l ON l.i = r.j),
least AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i)
SELECT s.doc_id, s.n AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM size s JOIN least l ON l.i = s.doc_id"""

#: crc32 by bits, then the levels of each source (low) and of the subroots (high), and a climb per leaf.
_MERKLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
texts AS (
  SELECT d.doc_id, source, lang, n_chars, text,
    CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
  FROM documents d LEFT JOIN crc USING (doc_id)),
parts AS (
  SELECT doc_id, source, changed, text,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS front FROM texts),
hashed AS (
  SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(front || coalesce(strlen(changed) || ':' || changed, '-')) AS changed FROM parts),
sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
leaves AS (
  SELECT h.doc_id, h.leaf, h.changed, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY h.doc_id NULLS FIRST, h.leaf) - 1 AS idx
  FROM hashed h JOIN sources s ON s.source IS NOT DISTINCT FROM h.source),
low AS (
  SELECT tree, 0 AS lv, idx, leaf AS digest, n AS rest FROM leaves
  UNION ALL
  SELECT tree, lv + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (rest + 15) // 16 FROM low WHERE rest > 1 GROUP BY tree, lv, idx // 16, rest),
subroots AS (SELECT tree, lv, digest FROM low WHERE rest = 1),
high AS (
  SELECT 0 AS lv, tree AS idx, digest, (SELECT count(*) FROM sources) AS rest FROM subroots
  UNION ALL
  SELECT lv + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (rest + 15) // 16 FROM high WHERE rest > 1 GROUP BY lv, idx // 16, rest),
runs AS (
  SELECT tree, lv, idx // 16 AS run, list(digest ORDER BY idx) AS kids FROM low WHERE rest > 1 GROUP BY tree, lv, idx // 16
  UNION ALL SELECT -1, lv, idx // 16, list(digest ORDER BY idx) FROM high WHERE rest > 1 GROUP BY lv, idx // 16),
climb AS (
  SELECT doc_id, leaf, tree AS home, idx AS no, tree, 0 AS lv, idx, changed AS fold, '' AS siblings FROM leaves
  UNION ALL
  SELECT c.doc_id, c.leaf, c.home, c.no, CASE WHEN r.kids IS NULL THEN -1 ELSE c.tree END, CASE WHEN r.kids IS NULL THEN 0 ELSE c.lv + 1 END,
    CASE WHEN r.kids IS NULL THEN c.home ELSE c.idx // 16 END,
    CASE WHEN r.kids IS NULL THEN c.fold ELSE sha256(array_to_string(r.kids[1:c.idx % 16], '') || c.fold || array_to_string(r.kids[c.idx % 16 + 2:], '')) END,
    CASE WHEN r.kids IS NULL THEN c.siblings ELSE c.siblings || array_to_string(r.kids[1:c.idx % 16], '') || array_to_string(r.kids[c.idx % 16 + 2:], '') END
  FROM climb c LEFT JOIN runs r ON r.tree = c.tree AND r.lv = c.lv AND r.run = c.idx // 16
  WHERE c.tree >= 0 OR r.kids IS NOT NULL),
root AS (SELECT digest FROM high WHERE rest = 1),
ends AS (SELECT c.* FROM climb c WHERE c.tree = -1 AND c.lv = (SELECT max(lv) FROM high))
SELECT e.doc_id, e.leaf, s.digest AS subroot, r.digest AS root, sha256(e.siblings) AS proof_sha256, e.fold AS folded_root, e.fold = r.digest AS verified
FROM ends e JOIN subroots s ON s.tree = e.home, root r"""

ORACLE: dict[str, str] = {"op1_chat_format": _chat_sql(), "op7_minhash": _MINHASH_SQL, "op9_embedding_neardup": _VECTORS_SQL,
                          "op11_merkle_manifest": _MERKLE_SQL}
