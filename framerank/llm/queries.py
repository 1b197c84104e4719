"""The queries ``opN_*`` over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framerank.llm import forest, mixing, neardup, orctokens, packing, prefixhash, rendezvous, sanitize, secretlinks, tagpaths


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.find(_table(spark, sf_dir, "documents"))


def op2_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.extract(_table(spark, sf_dir, "pages"))


def op3_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.shard_documents(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixhash.fingerprints(_table(spark, sf_dir, "documents"))


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orctokens.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretlinks.scan(_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"), width=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_disclosure, op2_tag_paths, op3_isolation_forest, op4_rendezvous, op5_mixing, op6_packing, op7_fingerprints, op8_orc_tokens, op9_credential_links, op10_minhash)}


#: All pairs with a shingle in common, counted; equal results, at a cost that only small tables allow.
MINHASH_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) END) AS s FROM words),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * k >= 80 * (len(x.s) + len(y.s) - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
SELECT doc_id, any_value(CAST(len(s) AS BIGINT)) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach JOIN sets USING (doc_id) GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    """The other operators rest on hashes, trees, tokenizers or patterns that SQL lacks; tests hold them against plain Python."""
    return {"op10_minhash": MINHASH_SQL}
