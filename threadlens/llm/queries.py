"""The registered queries of the corpus operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import scratch_path

from . import chat, codes, hmm, idfiles, langid, lattice, mixing, neardup, packing, quality, sharding, topk, trie
from .common import remainder, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~held_out))
    told = langid.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_ids(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


CONTROL_CASE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.table_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    case = spark.sql(f"SELECT id AS turn, -7L AS conv_id, '{CONTROL_CASE}' AS text, "
                     "CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role FROM range(2)")
    every = turns.unionByName(chat.table_turns(case, "conv_id", "turn"))
    return chat.read_back(chat.format_turns(every)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = topk.search(rows, rows.where("id % 100 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7, 2)
    scored = hmm.score(docs, *hmm.train(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op9_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"], SHARDS)


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "id-files")
    idfiles.write_ids(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return idfiles.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.link(table(spark, sf_dir, "embeddings"))


def op12_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_window_packing": op3_window_packing,
    "op4_chat_format": op4_chat_format,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_source_mixing": op6_source_mixing,
    "op7_hamming_top_k": op7_hamming_top_k,
    "op8_hmm_scores": op8_hmm_scores,
    "op9_shard_lookup": op9_shard_lookup,
    "op10_id_files": op10_id_files,
    "op11_lattice_links": op11_lattice_links,
    "op12_anchor_codes": op12_anchor_codes,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_round(i: int) -> str:
    """Parts dealt to the entries of b{i} as a{i}, and the entries they make as b{i + 1}."""
    return f"""
a{i} AS (SELECT p.vec_id, p.label, p.p, b.e, p.x,
                list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
         FROM parts p JOIN b{i} b USING (p) QUALIFY row_number() OVER (PARTITION BY p.vec_id, p.p ORDER BY d, b.e) = 1),
m{i} AS (SELECT p, e, list(f ORDER BY i) AS c FROM (
             SELECT p, e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS f
             FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY p, e, i) GROUP BY p, e),
b{i + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, e))"""


# A source stops at twice its size if, with every source given its weight times that
# source's ratio (and none above its own limit), the whole budget isn't used up.
ORACLES: dict[str, str] = {
    "op6_source_mixing": rf"""
WITH s AS (SELECT doc_id, source, len({WORDS}) AS size,
                  CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))), 1, 12)
                       AS BIGINT) AS h FROM documents),
names AS (SELECT source, sum(size) AS source_size,
                 CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
          FROM s GROUP BY source),
budget AS (SELECT sum(source_size) * CAST(1.5 AS DOUBLE) AS total FROM names),
fills AS (SELECT a.source, sum(least(2 * b.source_size, CAST(2 * a.source_size AS DOUBLE) / a.weight * b.weight)) AS used
          FROM names a, names b GROUP BY a.source),
stops AS (SELECT n.*, f.used <= (SELECT total FROM budget) AS stop
          FROM names n JOIN fills f ON n.source IS NOT DISTINCT FROM f.source),
level AS (SELECT ((SELECT total FROM budget) - coalesce(sum(2 * source_size) FILTER (stop), 0))
                 / sum(weight) FILTER (NOT stop) AS l FROM stops),
t AS (SELECT source, source_size,
             CASE WHEN stop THEN CAST(2 * source_size AS DOUBLE) ELSE (SELECT l FROM level) * weight END AS target,
             CASE WHEN stop OR source_size = 0 THEN 2 ELSE floor((SELECT l FROM level) * weight / source_size) END AS passes
      FROM stops),
c AS (SELECT s.*, t.source_size, t.target, t.passes, t.target - t.passes * t.source_size AS rest,
             sum(size) OVER (PARTITION BY s.source ORDER BY h) AS upto,
             sum(size) OVER (PARTITION BY s.source, h) AS own
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (passes + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))
                             THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""",
    "op4_chat_format": r"""
WITH every AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
               UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?ROLE\]|:\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g')) AS n,
             length(regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?ROLE\]|:\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g')) AS r FROM every)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE r + 16 END)
            AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    # Brute force: all pairs that share a shingle, then everything reachable.
    "op5_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (shingle)
          WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
          WHERE 100 * p.n >= 75 * (x.n + y.n - p.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)""",
    # Brute force: all pairs, then everything reachable.
    "op11_lattice_links": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE {FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)""",
    "op12_anchor_codes": f"""
WITH parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM (
    SELECT vec_id, label, unnest(range(16)) AS p,
           list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings WHERE {FINITE})),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 64),
{_codes_round(0)},{_codes_round(1)},{_codes_round(2)},
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM b2),
v AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
      FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT s FROM book) AS codebooks_sha256 FROM v""",
    # Brute force: every prefix of every conversation as a list. The checksum is taken byte by
    # byte: each byte of the decimal id is mixed in, then eight steps (-1) follow.
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS i, m, n
           FROM (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS m,
                        length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({'m': m, 'n': n} ORDER BY i) AS l FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, xor(4294967295, list_reduce(
          list_concat([4294967295], flatten(list_transform(regexp_extract_all(CAST(conv_id AS VARCHAR), '.'),
              lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 AS h FROM own),
c AS (SELECT h.conv_id, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h + 1:]) AS l
      FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
steps AS (SELECT conv_id, len(l) AS size, d, array_to_string(list_transform(l[1:d], lambda x: x['m']), '') AS node,
                 array_to_string(list_transform(l[1:greatest(d - 1, 0)], lambda x: x['m']), '') AS parent,
                 CASE WHEN d > 0 THEN l[d]['n'] ELSE 0 END AS chars
          FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM c)),
nodes AS (SELECT node, any_value(d) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
                 (count(*) - 1) * any_value(chars) AS gain,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
          FROM steps GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
under AS (SELECT substr(n.node, 1, 32 * d) AS node, CAST(sum(gain) AS BIGINT) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
          FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) n LEFT JOIN children k ON k.node = n.node GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.leaves AS n_leaves,
       u.saved AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent LEFT JOIN children k ON k.node = n.node
JOIN under u ON u.node = n.node""",
    # Brute force: every query against every row, bit by bit.
    "op7_hamming_top_k": r"""
WITH b AS (SELECT DISTINCT vec_id, i, embedding[i] > 0 AS bit
           FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
d AS (SELECT q.vec_id AS query_id, r.vec_id, count(*) FILTER (q.bit <> r.bit) AS distance
      FROM b q JOIN b r USING (i) WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id GROUP BY 1, 2)
SELECT query_id, rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 10""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
