"""Queries of the training-data operators, by the name under which they are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import (
    audio_features,
    compact_windows,
    html_extraction,
    lexical_search,
    line_dedup,
    merkle,
    near_dedup,
    packing,
    pitman_yor,
    quality_rules,
    sharding,
    speculative_bpe,
    sstable,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


WORD_BPE, BYTE_BPE, END_ID = "word_bpe_49k.json", "byte_bpe_50k.json", 2


def op1_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.write_and_read(spark, documents(spark, sf_dir), tokenizer_file(WORD_BPE), END_ID)


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audio_features.store_and_analyse(spark, documents(spark, sf_dir))
    return made.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.length("tensors").cast("long").alias("tensor_bytes")
    )


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated(spark, documents(spark, sf_dir))


def op7_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = speculative_bpe.encode_decode(documents(spark, sf_dir), tokenizer_file(WORD_BPE))
    return made.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(spark, documents(spark, sf_dir))


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(spark, documents(spark, sf_dir), 40)


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), tokenizer_file(BYTE_BPE), END_ID, 1024)


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(spark, documents(spark, sf_dir), words=4, percent=80)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(documents(spark, sf_dir))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken")
    )


def op11_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 50)


def op12_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.dedup(spark, documents(spark, sf_dir), 10)
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_incremental_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark, documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3))),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n >= 2) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(list_filter(ws, lambda w: list_contains(STOP_LIST, lower(w)))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN r USING (doc_id)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         concat_ws(',', RULE_LIST) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken = '' AS kept, broken FROM v
"""
OP4_SQL = OP4_SQL.replace("STOP_LIST", str(sorted(set(quality_rules.STOP_WORDS)))).replace(
    "RULE_LIST", ", ".join(f"CASE WHEN {r.num} * {r.scale} {r.op} {r.bound} * {r.den} THEN '{r.name}' END" for r in quality_rules.RULES)
)


OP11_SQL = r"""
WITH toks AS (
  SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t
  FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM toks GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, nd),
q AS (
  SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t
  FROM benchmark),
m AS (SELECT doc_id, 50 + (50 * n * nd) // l AS m FROM n, s),
x AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 50
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS goes FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""

OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 3 = 0 AS picked
  FROM documents),
f AS (
  SELECT doc_id, lang, picked, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front
  FROM crc),
h AS (
  SELECT doc_id, lang, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN picked THEN sha256(front || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
tree(lang, lvl, i, n, h) AS (
  SELECT lang, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 8, n),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS li, count(*) OVER () AS ln FROM tree WHERE n = 1),
top(lvl, i, n, h) AS (
  SELECT 0, li, ln, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 8, n),
depth AS (SELECT lang, max(lvl) AS depth FROM tree GROUP BY lang),
nodes AS (
  SELECT lang, false AS up, lvl, i, coalesce(string_agg(h, '') OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE n > 1 WINDOW a AS (PARTITION BY lang, lvl, i // 8 ORDER BY i)
  UNION ALL
  SELECT NULL, true, lvl, i, coalesce(string_agg(h, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), coalesce(string_agg(h, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')
  FROM top WHERE n > 1 WINDOW b AS (PARTITION BY lvl, i // 8 ORDER BY i)),
start AS (
  SELECT x.doc_id, x.lang, x.i, x.leaf, x.tampered, s.subroot, s.li, d.depth, row_number() OVER () AS id
  FROM leaves x JOIN subroots s ON x.lang IS NOT DISTINCT FROM s.lang JOIN depth d ON x.lang IS NOT DISTINCT FROM d.lang),
steps AS (
  SELECT id, n.lvl AS step, l, r FROM start x JOIN nodes n ON NOT n.up AND n.lang IS NOT DISTINCT FROM x.lang AND n.lvl < x.depth AND n.i = x.i // CAST(pow(8, n.lvl) AS BIGINT)
  UNION ALL
  SELECT id, x.depth + n.lvl, l, r FROM start x JOIN nodes n ON n.up AND n.i = x.li // CAST(pow(8, n.lvl) AS BIGINT)),
folds(id, step, h) AS (
  SELECT id, 0, coalesce(tampered, leaf) FROM start
  UNION ALL
  SELECT f.id, f.step + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN steps s ON s.id = f.id AND s.step = f.step),
folded AS (SELECT id, arg_max(h, step) AS folded_root FROM folds GROUP BY id),
proof AS (SELECT id, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY id)
SELECT x.doc_id, x.leaf, x.subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.h AS verified
FROM start x JOIN (SELECT h FROM top WHERE n = 1) t ON true JOIN folded f USING (id) LEFT JOIN proof p USING (id)
"""


def queries() -> dict:
    return {
        "op1_tag_path_ratios": op1_tag_path_ratios,
        "op2_sstable": op2_sstable,
        "op3_bottom_k": op3_bottom_k,
        "op4_quality_rules": op4_quality_rules,
        "op5_audio_features": op5_audio_features,
        "op6_compact_windows": op6_compact_windows,
        "op7_speculative_bpe": op7_speculative_bpe,
        "op8_pitman_yor": op8_pitman_yor,
        "op9_sampled_splitters": op9_sampled_splitters,
        "op10_best_two_fit": op10_best_two_fit,
        "op11_bit_sliced_search": op11_bit_sliced_search,
        "op12_line_bitmaps": op12_line_bitmaps,
        "op13_incremental_witnesses": op13_incremental_witnesses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": OP4_SQL,
        "op11_bit_sliced_search": OP11_SQL,
        "op12_line_bitmaps": OP12_SQL,
        "op13_incremental_witnesses": OP13_SQL,
    }
