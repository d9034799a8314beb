"""The operators applied to whole driver tables, with their SQL counterparts where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from plateworks.llm import bpe, fm_substring, heap_clusters, latent_decontam, patience_lines, prefix_trie, pu_quality, rule_ledger, sharding, simhash, suffix_induced, token_rollups, toxicity_grammar
from plateworks.llm.storage import shared_folder, stage, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_fm_substring(spark, sf_dir):
    return fm_substring.digest(fm_substring.deduplicated(table(spark, sf_dir, "documents")))


def op2_rule_ledger(spark, sf_dir):
    return rule_ledger.verdicts(table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op4_patience_lines(spark, sf_dir):
    return patience_lines.digest(patience_lines.deduplicated(table(spark, sf_dir, "documents"), runs=True))


def op5_toxicity_grammar(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity_grammar.scored(docs, toxicity_grammar.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_rollups(spark, sf_dir):
    """Totals after three batches over all documents: all inserted, by two tokenizer versions; those with repeated lines
    revised to the counts of their distinct lines; copies of a text with a smaller doc_id deleted. The second is committed twice."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")

    def events(kind, rows):
        counts = token_rollups.bpe_counts(rows, "byte_bpe_50k@1", ranks, pattern).unionByName(token_rollups.word_counts(rows, "words@1"))
        return counts.withColumn("kind", F.lit(kind))

    lines = F.split("text", "\n")
    shorter = docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    keyed = docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    first = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    copies = keyed.join(first, ["h1", "h2"]).where("doc_id > first").select("doc_id", "source", "lang")
    versions = F.explode(F.array(F.lit("byte_bpe_50k@1"), F.lit("words@1")))
    gone = copies.select(F.lit("delete").alias("kind"), "doc_id", "source", "lang", versions.alias("version"), F.lit(0).cast("long").alias("tokens"))
    rollup = token_rollups.Rollup(spark, f"{shared_folder(spark)}/llm/rollup-{uuid.uuid4().hex}")
    rollup.commit(1, events("insert", docs))
    revised = stage(events("revise", shorter), "revised")
    rollup.commit(2, revised)
    rollup.commit(2, revised)
    return rollup.commit(3, gone)


def op7_byte_bpe(spark, sf_dir):
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.decode(bpe.encode(docs, ranks, pattern).drop("text"), ranks, pattern))


def op8_latent_decontam(spark, sf_dir):
    return latent_decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_induced_sorting(spark, sf_dir):
    return suffix_induced.digest(suffix_induced.deduplicated(table(spark, sf_dir, "documents")))


def op10_external_shuffle(spark, sf_dir):
    return sharding.assignments(table(spark, sf_dir, "documents"))


def op11_pu_quality(spark, sf_dir):
    return pu_quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_heap_clusters(spark, sf_dir):
    return heap_clusters.clustered(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_fm_substring, op2_rule_ledger, op3_simhash, op4_patience_lines, op5_toxicity_grammar, op6_token_rollups, op7_byte_bpe, op8_latent_decontam, op9_induced_sorting, op10_external_shuffle, op11_pu_quality, op12_heap_clusters, op13_prefix_trie)}


def _centroid_rounds() -> str:
    """One pair of CTEs per round: the nearest centroid of every vector, then the floors of the means."""
    steps = [f"""c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{heap_clusters.SEED}' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM e ORDER BY h, v LIMIT {heap_clusters.CLUSTERS}))"""]
    nearest = """a{0} AS MATERIALIZED (SELECT r, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT e.r, e.vec_id, e.v, k.c,
        list_sum(list_transform(list_zip(e.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e CROSS JOIN c{0} AS k) GROUP BY r, vec_id, v)"""
    for n in range(heap_clusters.ROUNDS):
        steps += [nearest.format(n), f"""m{n} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS v FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
        FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY c, i) GROUP BY c)""",
                  f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))"]
    return ",\n".join([*steps, nearest.format(heap_clusters.ROUNDS)])


#: Unsigned crc32 of the decimal text of column c, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""

ORACLES = {
    "op2_rule_ledger": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g),
p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: x = '|')) AS bars, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low
      FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, (n_words < {rule_ledger.FEW_WORDS})::INT + 2 * (100 * n_repeat_words > {rule_ledger.REPEAT_PERCENT} * n_words)::INT
        + 4 * (100 * n_symbols > {rule_ledger.SYMBOLS_PER_100_WORDS} * n_words)::INT + 8 * (100 * n_dup_lines > {rule_ledger.DUP_LINE_PERCENT} * n_lines)::INT
        + 16 * (word_chars < {rule_ledger.MEAN_WORD_LOW} * n_words OR word_chars > {rule_ledger.MEAN_WORD_HIGH} * n_words)::INT
        + 32 * (100 * bars > {rule_ledger.BAR_WORD_PERCENT} * n_words)::INT + 64 * (100 * up > {rule_ledger.SHOUT_PERCENT} * (up + low))::INT AS bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failed_bits FROM b""",
    "op12_heap_clusters": f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({heap_clusters.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {heap_clusters.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
{_centroid_rounds()}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{heap_clusters.ROUNDS} JOIN c{heap_clusters.ROUNDS} AS k USING (c)""",
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, ({_CRC} % {prefix_trie.HEADS})::INTEGER AS h FROM t),
b AS (SELECT h.c, coalesce(list_slice(g.ts, 1, h.h), []) || list_slice(h.ts, h.h + 1, len(h.ts)) AS ts FROM h LEFT JOIN t AS g ON g.c = h.c - h.c % {prefix_trie.GROUP}),
p AS MATERIALIZED (SELECT c, len(ts) AS n, d, CASE WHEN d > 0 THEN ts[d].text ELSE '' END AS last, sha256(to_json(list_slice(ts, 1, d))::VARCHAR) AS k FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM b)),
f AS MATERIALIZED (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(len(list_filter(string_split_regex(last, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS w,
  sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM p GROUP BY k, d),
u AS (SELECT DISTINCT x.k AS k, y.k AS below, x.d AS d, y.d AS depth_below FROM p AS x JOIN p AS y ON x.c = y.c AND y.d >= x.d),
s AS (SELECT u.k, count(*) FILTER (WHERE depth_below = u.d + 1) AS n_children, sum((f.n_convs - 1) * f.w) AS saved FROM u JOIN f ON f.k = u.below GROUP BY u.k),
l AS (SELECT u.k, count(*) AS n_leaves FROM u JOIN s ON s.k = u.below WHERE s.n_children = 0 GROUP BY u.k),
q AS (SELECT DISTINCT y.k AS k, x.k AS above FROM p AS x JOIN p AS y ON x.c = y.c AND y.d = x.d + 1)
SELECT f.conv_id, f.d::BIGINT AS depth, a.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, s.n_children::BIGINT AS n_children, l.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s USING (k) JOIN l USING (k) LEFT JOIN q USING (k) LEFT JOIN f AS a ON a.k = q.above""",
}
