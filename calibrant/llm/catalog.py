"""The registered queries of the numbered operators, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from calibrant.llm import bagminhash, byte_bpe, chunk_recipes, conversation_trie, itq, mixing, ngram_lm, pii, quality, token_alignment, token_files, vector_search, warc
from calibrant.llm.tables import load

QUERIES = {}
CHECKS: dict[str, str] = {}


def query(function=None, *, sql: str | None = None):
    """Register a query under the name of its function; ``sql`` gives the same rows."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            CHECKS[function.__name__] = sql
        return function

    return register if function is None else register(function)


WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
  d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
  r AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000
        GROUP BY payload_digest)
  SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN response IS DISTINCT FROM page_id AND response IS NOT NULL THEN 'revisit'
      ELSE 'response' END AS record_type,
    CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
  FROM d LEFT JOIN r USING (payload_digest)"""

#: All pairs with a shingle in common, by the definition of weighted Jaccard similarity.
NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+') AS words FROM documents),
  s AS (SELECT doc_id, unnest(CASE WHEN len(words) >= 5
      THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
      WHEN len(words) > 0 THEN [concat(len(words), ' ', array_to_string(words, ' '))] ELSE [] END)
    AS shingle FROM w),
  c AS (SELECT doc_id, shingle, count(*) AS n FROM s GROUP BY doc_id, shingle),
  t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS both_
    FROM c a JOIN c b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
  l AS (SELECT a, b FROM o JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b
    WHERE 5 * both_ >= 4 * (x.total + y.total - both_)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
  SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM reach GROUP BY a"""

LINKED = """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
    ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
  reach AS (SELECT vec_id AS a, vec_id AS b FROM e
    UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
  SELECT r.a AS vec_id, coalesce(any_value(n), 0) AS n_links, min(r.b) AS component_id,
    r.a = min(r.b) AS kept FROM reach r
  LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = r.a GROUP BY r.a"""


COPIES = """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
  g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
  FROM n JOIN g USING (body)"""

#: Nodes by whole prefixes; the ancestors of a node are the prefixes of its smallest member.
TRIE = """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS rk
    FROM conversations WHERE conv_id IS NOT NULL),
  o AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
  g AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, xor(CAST(4294967295 AS BIGINT),
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
        lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)))) % 6 AS h
    FROM o),
  c AS (SELECT g.conv_id, h, base, least(h, coalesce(b.own, 0)) AS n_head,
    least(h, coalesce(b.own, 0)) + greatest(g.own - h, 0) AS total FROM g LEFT JOIN o b ON b.conv_id = base),
  r AS (SELECT c.conv_id, rk AS pos, role, text FROM c JOIN t ON t.conv_id = base AND rk <= h
    UNION ALL SELECT c.conv_id, rk - h + n_head, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND rk > h),
  p AS (SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS chars FROM c UNION ALL
    SELECT conv_id, pos, string_agg(concat(strlen(role), ':', role, strlen(text), ':', text), '')
      OVER (PARTITION BY conv_id ORDER BY pos), length(text) FROM r),
  n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(chars) * (count(*) - 1) AS saved FROM p GROUP BY depth, prefix),
  m AS (SELECT p.conv_id AS member, p.depth, n.conv_id AS node FROM p JOIN n USING (depth, prefix)),
  u AS (SELECT n.conv_id, n.depth, m.node AS parent_conv_id, n_convs, saved
    FROM n LEFT JOIN m ON m.member = n.conv_id AND m.depth = n.depth - 1),
  k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u
    WHERE depth > 0 GROUP BY ALL),
  w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (conv_id, depth)),
  s AS (SELECT m.node AS conv_id, m.depth, count(*) FILTER (n_children = 0) AS n_leaves,
    CAST(sum(saved) AS BIGINT) AS saved_tokens FROM w JOIN m ON m.member = w.conv_id AND m.depth <= w.depth
    GROUP BY ALL),
  e AS (SELECT node AS conv_id, depth, sha256(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member)) AS ends
    FROM m JOIN c ON c.conv_id = member AND total = depth GROUP BY ALL)
  SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    coalesce(ends, sha256('')) AS ends_sha256
  FROM w JOIN s USING (conv_id, depth) LEFT JOIN e USING (conv_id, depth)"""


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(
        load(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query(sql=WARC)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_table(load(spark, sf_dir, "pages"))


@query
def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(load(spark, sf_dir, "documents"))


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(
        load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(sql=NEAR)
def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.class_table(load(spark, sf_dir, "documents"))


@query(sql=LINKED)
def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.link_vectors(load(spark, sf_dir, "embeddings"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_table(load(spark, sf_dir, "documents"))


@query
def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search_table(load(spark, sf_dir, "embeddings"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(load(spark, sf_dir, "documents"))


@query(sql=COPIES)
def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.duplicate_table(load(spark, sf_dir, "documents"))


@query(sql=TRIE)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie_table(load(spark, sf_dir, "conversations"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_table(
        load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))
