"""One registered query for each operator, over its whole table with production parameters, and the SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from demandgrid.llm import bpe, extract, filter_audit, langid, lines, mixing, neighbours, pii, prefix_trie, quality, sharding, simhash, token_counts
from demandgrid.llm.base import query, table

RANK_FILE = "byte_bpe_50k.tiktoken"

#: Target weights in hundredths; sources that aren't named share the rest.
RECIPE = {"src0": 10} | {f"src{i}": 8 for i in range(1, 5)} | {f"src{i}": 6 for i in range(5, 10)} | {
    f"src{i}": 4 for i in range(10, 15)}
OTHER_WEIGHT = 8
HELD_OUT = 1


def tokenizer(spark, path: str | None = None) -> bpe.Tokenizer:
    return bpe.Tokenizer(spark, path or public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    ratio = {"mean_word_length": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words",
             "capitals_per_letter": "n_capitals / n_letters", "stop_word_share": "n_stop_words / n_words",
             "duplicate_line_share": "n_dup_lines / n_lines", "bullet_line_share": "n_bullets / n_lines",
             "ellipsis_line_share": "n_ellipses / n_lines", "repeated_word_share": "n_repeat_words / n_words"}
    broken = []
    for r in quality.RULES:
        value = f"CAST({ratio[r.measure]} AS DOUBLE)" if r.measure in ratio else r.measure
        if r.measure in ratio:
            a, b = ratio[r.measure].split(" / ")
            value = f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END)"
        bounds = [f"{value} < CAST({r.least} AS DOUBLE)"] if r.least is not None else []
        bounds += [f"{value} > CAST({r.most} AS DOUBLE)"] if r.most is not None else []
        broken.append(f"CASE WHEN {' OR '.join(bounds)} THEN '{r.name}' END")
    return rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS l FROM t),
p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM p),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, sum(n) AS n FROM (SELECT r, least(3, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 3)) AS n
  FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[ \x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
  length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
  len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullets,
  len(list_filter(l, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) AS n_ellipses
  FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, concat_ws(',', {', '.join(broken)}) AS failed, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept,
  failed FROM f"""


@query("op1_quality_rules", _quality_sql())
def op1_quality_rules(spark, sf_dir):
    out = quality.quality_verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.concat_ws(",", "failed").alias("failed"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    t = tokenizer(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", t.encode_packed(F.col("text")).alias("ids"))
    decoded = docs.select("doc_id", "ids", t.decode_packed(F.col("ids")).alias("decoded"))
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_mix_sources")
def op3_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, RECIPE, other=OTHER_WEIGHT).select("doc_id", "pool", "block", "slot", "offset")


@query("op4_language")
def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == HELD_OUT, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), langid.predict(docs, model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


LINE_RATIO, LINE_PAGES = 0.1, 5


@query("op5_line_dedup", rf"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT DISTINCT source, text, line FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM pages)
  WHERE regexp_matches(line, '[^ \x09-\x0D]')),
whole AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
c AS (SELECT source, line, count(*) AS n FROM l GROUP BY source, line HAVING count(*) >= {LINE_PAGES}),
b AS (SELECT c.source, list(line) AS marks FROM c JOIN whole w ON c.source IS NOT DISTINCT FROM w.source
  WHERE n > CAST({LINE_RATIO} AS DOUBLE) * pages GROUP BY c.source),
k AS (SELECT doc_id, string_split(d.text, chr(10)) AS lines,
  list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(marks, x), false)) AS kept
  FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, coalesce(len(lines), 0) AS n_lines,
  coalesce(len(lines) - len(kept), 0) AS n_dropped FROM k""")
def op5_line_dedup(spark, sf_dir):
    out = lines.drop_boilerplate(table(spark, sf_dir, "documents"), ratio=LINE_RATIO, min_pages=LINE_PAGES)
    return out.select("row.doc_id", F.col("clean").alias("text"), "n_lines", "n_dropped")


@query("op6_main_text")
def op6_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract.extract_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = docs.select("doc_id", token_counts.count_tokens(tokenizer(spark), F.col("text")).alias("c"))
    # every text has a section; a plain inline would have the encoding run again, to filter empty arrays first
    return counts.select("doc_id", F.inline_outer("c"))


@query("op8_balanced_shards")
def op8_balanced_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op9_nearest_vectors")
def op9_nearest_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("op10_near_duplicates")
def op10_near_duplicates(spark, sf_dir):
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_personal_data")
def op11_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = docs.select("doc_id", pii.find_spans(docs, pii.fit(docs), F.col("text")).alias("s"))
    base = F.filter("s", lambda s: s["base"])

    def joined(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"),
                        F.size(F.filter("s", lambda s: ~s["base"])).cast("long").alias("n_added"))


@query("op12_prefix_trie", r"""
WITH RECURSIVE
bits(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc(conv_id, rest, v) AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 4294967295 FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, substr(rest, 2), xor(crc.v >> 8, bits.v) FROM crc JOIN bits ON k = 8 AND i = xor(crc.v & 255, ascii(rest))
  WHERE rest <> ''),
h AS (SELECT conv_id, xor(v, 4294967295) % 4 AS h FROM crc WHERE rest = ''),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 128), md5(text)) AS pos,
  md5(md5(role) || md5(text)) AS m, len(list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '')) AS words FROM t),
r AS (SELECT h.conv_id, pos, m, words FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND pos <= h
  UNION ALL SELECT conv_id, pos, m, words FROM h JOIN o USING (conv_id) WHERE pos > h),
c AS (SELECT conv_id, coalesce(list(m ORDER BY pos) FILTER (m IS NOT NULL), []) AS path,
  coalesce(list(words ORDER BY pos) FILTER (m IS NOT NULL), []) AS words FROM h LEFT JOIN r USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, path, words, unnest(range(len(path) + 1)) AS depth FROM c),
n AS (SELECT depth, path[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
  (count(*) - 1) * coalesce(any_value(words[depth]), 0) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM p GROUP BY depth, prefix),
k AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
b AS (SELECT n.prefix, sum(v.saved)::BIGINT AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
  FROM n JOIN m v ON v.prefix[1:n.depth] = n.prefix GROUP BY n.prefix)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN b USING (prefix) LEFT JOIN n u ON m.depth > 0 AND u.prefix = m.prefix[1:m.depth - 1]""")
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("x", "y")


@query("op13_filter_audit", r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
  list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
  + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask,
  CAST(coalesce(good, false) AS INT) AS good, CAST(coalesce(toxic, false) AS INT) AS toxic FROM w LEFT JOIN k USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(l, b)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest(range(1, 6))::INT AS step))
SELECT part, filter_order, step, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  (SELECT sum(120 // bit_count(x.mask) * x.n) FROM c x WHERE x.part = c.part AND x.mask & s.own <> 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step, own""")
def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
