"""Registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demoforge.llm import (
    alignment,
    bpe_trie,
    exact_dedup,
    langid,
    packing,
    pivot_index,
    prefix_trie,
    quality,
    secret_scan,
    simhash,
    suffix_repeats,
    token_files,
    toxicity,
)
from demoforge.llm.common import Workspace
from demoforge.llm.encode import default_tokenizer
from demoforge.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), default_tokenizer())


@query
def op2_simhash(spark, sf_dir):
    return simhash.components(read_table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_token_files(spark, sf_dir):
    path = Workspace(spark, "token-files").path("files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, default_tokenizer())
    return token_files.read_token_files(spark, path, with_ids=False)


@query
def op5_langid(spark, sf_dir):
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query
def op6_bpe_trie(spark, sf_dir):
    return bpe_trie.encode_documents(read_table(spark, sf_dir, "documents"), default_tokenizer(), with_text=False)


@query
def op7_ordinal_quality(spark, sf_dir):
    return quality.assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op8_pivot_index(spark, sf_dir):
    return pivot_index.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(read_table(spark, sf_dir, "documents"))


ORACLES["op9_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op10_suffix_repeats(spark, sf_dir):
    return suffix_repeats.removals(read_table(spark, sf_dir, "documents"))


@query
def op11_token_alignment(spark, sf_dir):
    return alignment.align(read_table(spark, sf_dir, "documents"), default_tokenizer(), alignment.default_pieces())


@query
def op12_secret_scan(spark, sf_dir):
    return secret_scan.scan(read_table(spark, sf_dir, "documents"), default_tokenizer())


@query
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.rebuilt_trie(read_table(spark, sf_dir, "conversations"))


#: CRC-32 bit by bit; a conversation's prefixes as lists; nodes by (depth, prefix)
ORACLES["op13_prefix_trie"] = """
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda k: ascii(k)::BIGINT)),
    lambda a, k: list_reduce(list_prepend(xor(a, k), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                             lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (
  SELECT convs.c, 0 AS side, own.p, x FROM convs JOIN own ON own.c = base AND own.p < h
  UNION ALL
  SELECT convs.c, 1, own.p, x FROM convs JOIN own ON own.c = convs.c AND own.p >= h),
paths AS (
  SELECT c, count(*) OVER w AS d, x.t AS t, list(x) OVER w AS path FROM rebuilt
  WINDOW w AS (PARTITION BY c ORDER BY side, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT c, 0, '', [] FROM convs),
ends AS (SELECT c, max(d) AS last FROM paths GROUP BY c),
nodes AS (
  SELECT min(paths.c) AS conv_id, d AS depth, count(*) AS n, any_value(length(t)) AS size,
         sha256(coalesce(string_agg(paths.c::VARCHAR, ',' ORDER BY paths.c) FILTER (d = last), '')) AS ends_sha256,
         list(paths.c) AS members
  FROM paths JOIN ends USING (c) GROUP BY d, path),
places AS (SELECT unnest(members) AS c, depth, conv_id AS node FROM nodes),
linked AS (
  SELECT nodes.*, places.node AS parent, (SELECT count(*) FROM nodes AS k JOIN places AS q ON q.c = k.conv_id AND q.depth = k.depth - 1
                                          WHERE k.depth = nodes.depth + 1 AND q.node = nodes.conv_id) AS kids
  FROM nodes LEFT JOIN places ON places.c = nodes.conv_id AND places.depth = nodes.depth - 1),
totals AS (
  SELECT places.node AS conv_id, places.depth, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
         sum((n - 1) * size)::BIGINT AS saved_tokens
  FROM linked JOIN places ON places.c = linked.conv_id AND places.depth <= linked.depth GROUP BY ALL)
SELECT conv_id, depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, n_leaves, saved_tokens, ends_sha256
FROM linked JOIN totals USING (conv_id, depth)
"""
