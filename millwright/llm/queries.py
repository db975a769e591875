"""One query per training-data operator: thin digests over the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import bpe, fim, linedupe, mixing, openbins, packing, pii, prefixtrie, quality, sharding, simhash, substring, topk
from millwright.llm.common import prepare, stored
from millwright.sources.testdata import table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return deco


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@_query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: shingles of 3 words, at most 3 bits."""
    found = simhash.near_duplicates(_documents(spark, sf_dir), shingle=3, bits=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query(
    "op2_substring_dedup",
    r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(len(w) - 49)) AS i, w FROM words WHERE len(w) >= 50),
hashed AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM windows),
least AS (SELECT h, min(doc_id) AS lo FROM hashed GROUP BY h),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM hashed JOIN least USING (h) WHERE doc_id > lo),
each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM words),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM each ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words removed and digest of what stays, for passages of 50 words."""
    out = substring.dedup_passages(_documents(spark, sf_dir), min_words=50)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", _sha(F.col("kept")).alias("kept_sha256"))


@_query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans."""
    found = pii.personal_data(_documents(spark, sf_dir))
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, pii.KINDS), F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


@_query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 2048 token ids packed from all documents, with segments, positions and the documents in them."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return packing.pack(_documents(spark, sf_dir), path, pattern, end_id=50256, length=2048)


@_query("op5_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document and its place there; sizes of shards near equal (law ``bytes``)."""
    out = sharding.shard(_documents(spark, sf_dir), shards=16)
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
    )


@_query(
    "op6_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, line, pos, common.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines dropped and digest of what stays."""
    out = linedupe.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc.doc_id", "lines.n_lines", "lines.n_dropped", _sha(F.col("doc.text")).alias("kept_sha256"))


@_query(
    "op7_topk",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every vector whose id is divisible by 50, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@_query("op8_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mixing.drawn(_documents(spark, sf_dir), ["doc_id"])
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"))


@_query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encode(_documents(spark, sf_dir), path, pattern, ["doc_id"], decoded=True)
    ids = F.sha2(F.array_join("ids", " "), 256)
    return out.select("doc.doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and divergence verdict of every document."""
    judged = quality.quality_rules(_documents(spark, sf_dir), ["doc_id"])
    return judged.select("doc.doc_id", "quality.*")


@_query(
    "op11_fim",
    """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
cut AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(t) + 1) AS a,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(t) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, substring(t, 1, least(a, b)) AS p, substring(t, least(a, b) + 1, abs(a - b)) AS m, substring(t, greatest(a, b) + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cut and digests of every document turned to fill-in-middle: 90 % of them, a fifth of these suffix first."""
    out = fim.fill_in_middle(_documents(spark, sf_dir), ["doc_id"], seed=1, percent=90, spm_percent=20)
    restored = fim.restore(F.col("fim.output"), F.col("fim.form"))
    columns = [F.col(f"fim.{c}") for c in ("n", "form", "prefix_chars", "middle_chars")]
    return out.select("doc.doc_id", *columns, _sha(F.col("fim.output")).alias("output_sha256"), _sha(restored).alias("restored_sha256"))


@_query(
    "op12_prefix_trie",
    r"""
WITH turns AS (
  SELECT conv_id, list({'id': md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')),
                        'w': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
drawn AS (
  SELECT conv_id, l, CAST(xor(list_reduce(
           list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS INTEGER) AS h
  FROM turns),
rebuilt AS (
  SELECT d.conv_id, list_concat(CASE WHEN h = 0 OR b.l IS NULL THEN [] ELSE b.l[1:h] END, d.l[h + 1:]) AS l
  FROM drawn d LEFT JOIN turns b ON b.conv_id = d.conv_id - d.conv_id % 20),
prefixes AS (
  SELECT conv_id, len(l) AS n, unnest(range(len(l) + 1)) AS depth, l FROM rebuilt),
keyed AS (
  SELECT conv_id, n, depth, array_to_string(list_transform(CASE WHEN depth = 0 THEN [] ELSE l[1:depth] END, lambda x: x.id), '') AS k,
         CASE WHEN depth = 0 THEN 0 ELSE l[depth].w END AS w FROM prefixes),
nodes AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM keyed GROUP BY k, depth),
children AS (
  SELECT left(k, 32 * (depth - 1)) AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT left(k, 32 * up) AS k, sum((n_convs - 1) * w) AS saved, count(*) FILTER (WHERE k NOT IN (SELECT k FROM children)) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM nodes) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (k) LEFT JOIN children USING (k) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.k = left(n.k, 32 * (n.depth - 1))
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each with up to 3 turns of the conversation that heads its twenty."""
    convs = stored(prefixtrie.sequences(table(spark, sf_dir, "conversations")), "conversations")
    return prefixtrie.prefix_trie(prefixtrie.with_shared_heads(convs)).drop("digest")


@_query("op13_best_fit")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 token ids."""
    return openbins.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, length=1024)
