"""One query for each operator over its whole table, and SQL where SQL can tell the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from salesloom.llm import classifier, katz, pii
from salesloom.llm.bpe import encode_documents
from salesloom.llm.common import table
from salesloom.llm.exact import exact_groups
from salesloom.llm.html_paths import extract
from salesloom.llm.merkle import manifest
from salesloom.llm.mixing import allocate
from salesloom.llm.packing import pack
from salesloom.llm.rules import judge
from salesloom.llm.simhash import near_duplicates
from salesloom.llm.suffix_dedup import remove_repeats
from salesloom.llm.whitening import whiten

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_paths(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


def op3_katz(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score_documents(table(spark, folder, "documents"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = allocate(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"), VOCABULARY)


def op10_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), BYTE_VOCABULARY)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(table(spark, folder, "documents"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_paths": op1_html_paths,
        "op2_pii": op2_pii,
        "op3_katz": op3_katz,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_mixing": op5_mixing,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_simhash": op8_simhash,
        "op9_bpe": op9_bpe,
        "op10_exact": op10_exact,
        "op11_packing": op11_packing,
        "op12_whitening": op12_whitening,
        "op13_merkle": op13_merkle,
    }


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

# DuckDB has no CRC-32: byte by byte, eight shifts each.
_CRC = """4294967295 - list_reduce(
    list_concat([4294967295], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                                             lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))),
    lambda crc, byte: list_reduce(
        list_concat([xor(CAST(crc AS BIGINT), CAST(byte AS BIGINT))], range(1, 9)),
        lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND ({_CRC}) % 5 = 0 THEN sha256({_HEAD} || {_FIELD.format(
             "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS forged
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, forged NULLS FIRST) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS m, row_number() OVER () AS rid
  FROM leaves
), nodes AS (
  SELECT 0 AS k, source, i, leaf AS digest, m FROM placed
  UNION ALL
  SELECT k + 1, source, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (any_value(m) + 15) // 16
  FROM nodes WHERE m > 1 GROUP BY k, source, i // 16
), subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j, count(*) OVER () AS trees
  FROM nodes WHERE m = 1
), tops AS (
  SELECT 0 AS k, j AS i, digest, trees AS m FROM subroots
  UNION ALL
  SELECT k + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (any_value(m) + 15) // 16
  FROM tops WHERE m > 1 GROUP BY k, i // 16
), steps AS (
  SELECT p.rid, n.k AS k,
         coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i < p.i // (16 ** n.k)::BIGINT), '') AS l,
         coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i > p.i // (16 ** n.k)::BIGINT), '') AS r
  FROM placed p JOIN nodes n
    ON n.source IS NOT DISTINCT FROM p.source AND n.i // 16 = p.i // (16 ** (n.k + 1))::BIGINT AND n.m > 1
  GROUP BY p.rid, n.k
  UNION ALL
  SELECT p.rid, 1000 + t.k,
         coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i < s.j // (16 ** t.k)::BIGINT), ''),
         coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i > s.j // (16 ** t.k)::BIGINT), '')
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
  JOIN tops t ON t.i // 16 = s.j // (16 ** (t.k + 1))::BIGINT AND t.m > 1
  GROUP BY p.rid, t.k
), paths AS (
  SELECT rid, string_agg(l || r, '' ORDER BY k) AS siblings, list({{'l': l, 'r': r}} ORDER BY k) AS path
  FROM steps GROUP BY rid
), folded AS (
  SELECT p.doc_id, p.leaf, s.digest AS subroot, (SELECT digest FROM tops WHERE m = 1) AS root,
         sha256(coalesce(q.siblings, '')) AS proof_sha256,
         list_reduce(
           list_concat([{{'l': coalesce(p.forged, p.leaf), 'r': ''}}], coalesce(q.path, [])),
           lambda a, b: {{'l': sha256(b.l || a.l || b.r), 'r': ''}}).l AS folded_root
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN paths q ON q.rid = p.rid
)
SELECT *, folded_root = root AS verified FROM folded
"""


def sql_by_query() -> dict[str, str]:
    return {"op10_exact": EXACT_SQL, "op13_merkle": MERKLE_SQL}
