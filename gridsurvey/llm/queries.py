"""One query per operator, each over its whole table, next to equal SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    embedding_join,
    exact_dedup,
    html_extract,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    prefix_trie,
    quotes,
    substring_dedup,
    toxicity,
    turn_repair,
)
from .common import fold, read
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("op8_html_extract")
def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op9_exact_dedup", sql="""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


@query("op4_embedding_join")
def op4_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op5_ngram_join")
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_near_documents(read(spark, sf_dir, "documents"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(
        read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    # The ids travel with the document through the decoder, under its id; of the offsets only the digest does.
    tagged = ids.select(F.struct("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                 F.sha2("ids", 256).alias("ids_sha256"),
                                 F.sha2(F.concat("starts", "ends"), 256).alias("offsets_sha256")).alias("doc"), "ids")
    return byte_bpe.decode(tagged, ranks, id_col="doc").select(
        "doc_id.*", F.sha2("data", 256).alias("decoded_sha256"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    machine = toxicity.learn_toxicity(docs, labels)
    return toxicity.toxicity(docs, machine).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op2_line_dedup", sql="""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
filled AS (SELECT doc_id, pos, trim(line) AS t FROM lines WHERE trim(line) <> ''),
windows AS (
  SELECT doc_id, pos AS a, lead(pos, 2) OVER doc AS b, t || chr(10) || lead(t) OVER doc || chr(10) || lead(t, 2) OVER doc AS w
  FROM filled WINDOW doc AS (PARTITION BY doc_id ORDER BY pos)),
placed AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, a) AS n FROM windows WHERE b IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos, TRUE AS out FROM placed WHERE n > 1)
SELECT doc_id, count(*) AS n_lines, count(out) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE out IS NULL), '') AS text
FROM lines LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_lines(read(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    profiles = language_id.learn_profiles(docs.filter("not held_out"))
    found = language_id.predict_language(spark, F.col("text"), profiles)
    return docs.select("doc_id", "held_out", found.alias("found")).select("doc_id", "held_out", "found.*")


@query("op10_chat_format", sql=r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM (
    SELECT conv_id, turn, string_split(translate(coalesce(text, ''), chr(1) || chr(2) || chr(13), ''), chr(10)) AS parts
    FROM conversations)),
levels AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+[ \t]?'), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS body FROM lines),
marked AS (
  SELECT *, lead(level, 1, 0) OVER message AS after,
    CASE WHEN level = lag(level) OVER message AND trim(body) <> '' AND trim(lag(body) OVER message) <> '' THEN 0 ELSE 1 END AS opens
  FROM levels WINDOW message AS (PARTITION BY conv_id, turn ORDER BY pos)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM marked),
paragraphs AS (
  SELECT conv_id, turn, run, any_value(level) AS level,
    lower(trim(regexp_replace(string_agg(body, ' ' ORDER BY pos), '\s+', ' ', 'g'))) AS words
  FROM runs GROUP BY conv_id, turn, run HAVING words <> ''),
linked AS (
  SELECT q.conv_id, q.turn, q.run, q.level, max(o.turn) AS origin FROM paragraphs q LEFT JOIN paragraphs o
    ON o.conv_id = q.conv_id AND o.words = q.words AND o.level = 0 AND o.turn < q.turn
  WHERE q.level > 0 GROUP BY q.conv_id, q.turn, q.run, q.level),
parents AS (
  SELECT conv_id, turn, origin AS parent_turn FROM linked WHERE origin IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, origin DESC) = 1),
counts AS (SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked FROM linked GROUP BY conv_id, turn),
chains AS (
  SELECT conv_id, turn, turn AS here, 0 AS depth FROM conversations
  UNION ALL SELECT c.conv_id, c.turn, p.parent_turn, c.depth + 1 FROM chains c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.here),
roots AS (SELECT conv_id, turn, min(here) AS root_turn, max(depth) AS depth FROM chains GROUP BY conv_id, turn),
own AS (
  SELECT conv_id, turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY pos), ''),
    '^(?:[ \t]*\n)+|(?:\n[ \t]*)+$|^[ \t]+$', '', 'g') AS text
  FROM marked WHERE level = 0 AND NOT (regexp_matches(body, '^\s*On\b.*\bwrote:\s*$') AND after > 0) GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, r.root_turn, p.parent_turn, r.depth, coalesce(c.n_quotes, 0) AS n_quotes,
  coalesce(c.n_linked, 0) AS n_linked, coalesce(o.text, '') AS text,
  '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || coalesce(o.text, '') || chr(10) || '<|end|>' || chr(10) AS formatted
FROM conversations m LEFT JOIN roots r USING (conv_id, turn) LEFT JOIN parents p USING (conv_id, turn)
LEFT JOIN counts c USING (conv_id, turn) LEFT JOIN own o USING (conv_id, turn)""")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(read(spark, sf_dir, "conversations")).drop("unlinked")


@query("op11_prefix_trie", sql="""
WITH ordered AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295] || flatten(list_transform(
      string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)),
heads AS (SELECT c.conv_id, o.i AS depth, key, chars FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.i <= c.h),
sizes AS (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id),
turns AS (
  FROM heads UNION ALL SELECT conv_id, i - h + coalesce(n, 0), key, chars
  FROM ordered JOIN convs USING (conv_id) LEFT JOIN sizes USING (conv_id) WHERE i > h),
prefixes AS (
  SELECT conv_id, depth, chars, list(key) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
named AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM prefixes),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM named GROUP BY path, depth),
linked AS (SELECT n.*, p.path AS parent FROM nodes n LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT parent AS path, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (path)),
below AS (
  SELECT a.path, sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves
  FROM counted u JOIN prefixes a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.path)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves, b.saved_tokens, c.ends_sha256
FROM counted c JOIN below b USING (path) LEFT JOIN nodes p ON p.path = c.parent AND c.depth > 0""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"))


@query("op12_turn_repair")
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turn_repair.repair_conversations(turn_repair.damaged(turns), turns)


@query("op13_substring_dedup", sql=r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM texts),
placed AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s:s + 19], ' ') ORDER BY doc_id, s) AS n FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM placed WHERE n > 1),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM (SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM texts) ANTI JOIN gone USING (doc_id, pos)
  GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)""")
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeated_passages(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
