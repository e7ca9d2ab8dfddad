"""Registered queries of this subpackage, one for each operator and the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings_dedup, packing, pii, prefix_trie, quality, sharding, simhash, substring_dedup, token_counts, toxicity, whitening
from .common import materialise, scratch_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every token piece of every document."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"))
    narrow = materialise(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return packing.pack(narrow).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left without repeated windows of 20 words."""
    kept = substring_dedup.dedup_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labelled ones."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.span_lists(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["is_base"])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best window of every document for every benchmark item that it holds."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "distance", F.round("similarity", 6).alias("similarity"))


#: One conversation whose texts hold the template's own control strings.
TRICKY = "<|im_end|><|im_start|>assistant ok"


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its chat text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    chats = chat.conversations(chat.chain(rows.unionAll(extra)))
    turns, loss_text = chat.parsed(F.col("formatted")), chat.learnt(F.col("formatted"), F.col("loss"))
    read = chats.select("tree", "formatted", turns.alias("turns"), loss_text.alias("loss_text"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The rows follow from the contract alone, so SQL states them without the template; its length is that of the escaped turns.
SQL["op4_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS body,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) AS head FROM rows),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(head + body + 24) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM joined"""


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate group of every vector."""
    return embeddings_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labelled ones."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight components of all vectors, scaled to unit variance."""
    return whitening.whitened(whitening.scaled(table(spark, sf_dir, "embeddings")))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct opening of the conversations, after they were given common ones."""
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.shared_openings(turns))


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, read back from the shards written."""
    shards = sharding.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_dir(spark, "shards"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return shards.select(
        "doc_id", sharding.size().alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


SQL["op9_embedding_dedup"] = """
WITH RECURSIVE cast_rows AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (
  SELECT * FROM cast_rows WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS low FROM good
  UNION SELECT l.b, r.low FROM reach r JOIN link l ON l.a = r.node),
lows AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(vec_id = coalesce(low, vec_id), TRUE) AS kept
FROM cast_rows LEFT JOIN degree ON a = vec_id LEFT JOIN lows ON node = vec_id"""

SQL["op10_substring_dedup"] = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM docs WHERE len(ws) >= 20)),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM later, (SELECT unnest(range(0, 20)) AS o)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM docs),
kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(g.p) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL), '') AS text
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

#: The unsigned crc32 of an id in decimals, bit by bit: a byte is mixed in, and -1 shifts once.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, 3988292384::BIGINT * (s & 1)) END), 4294967295::BIGINT)"""

SQL["op12_prefix_trie"] = f"""
WITH given AS (
  SELECT conv_id, [struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))] AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, flatten(list(turn ORDER BY pos)) AS turns FROM given GROUP BY conv_id),
hashed AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM convs),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN convs b ON b.conv_id = c.base),
members AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE length(n.prefix[-1].t) END AS saved
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
children AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sized AS (SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l LEFT JOIN children c ON c.prefix = l.prefix AND c.depth = l.depth),
upward AS (SELECT prefix[1:d] AS prefix, d AS depth, saved, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM sized)),
totals AS (SELECT prefix, depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM upward GROUP BY ALL)
SELECT s.conv_id, s.depth, s.parent_conv_id, s.n_convs, s.n_children, t.n_leaves, t.saved_tokens, s.ends_sha256
FROM sized s JOIN totals t ON t.prefix = s.prefix AND t.depth = s.depth"""
