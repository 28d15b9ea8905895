"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, html_extract, line_dedup, mixing, periodic_runs, quality_rules, sharding, simhash_dedup, substring_dedup, token_alignment, toxicity, vector_graph
from tidemark.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("removed")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.cluster(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_graph.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
    "op11_vector_graph": op11_vector_graph,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}

SQL = {
    "op1_substring_dedup": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (
            SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM docs, unnest(range(1, len(w) - 48)) u(i)
        ), repeated AS (
            SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM starts) WHERE doc_id > low
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS i FROM repeated, range(0, 50) r(k)
        ), kept AS (
            SELECT doc_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (g.i IS NULL), '') AS rest
            FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs) LEFT JOIN gone g USING (doc_id, i)
            GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)
    """,
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, line, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
        ), leaves AS (
            SELECT len(t) AS n, t[1:3] AS head FROM lines WHERE len(t) > 0 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10
        ), inside AS (
            SELECT DISTINCT n, head, t, doc_id FROM lines JOIN leaves ON len(t) = n AND t[1:3] = head
        ), masked AS (
            SELECT DISTINCT n, head, t FROM inside
        ), placed AS (
            SELECT n, head, t, i, t[i] AS token FROM masked, range(4, n + 1) r(i)
        ), constant AS (
            SELECT n, head, i, token FROM placed JOIN inside USING (n, head, t) WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10
        ), rest AS (
            SELECT n, head, t, list(CASE WHEN c.token IS NULL THEN '<*>' ELSE p.token END ORDER BY i) AS rest
            FROM placed p LEFT JOIN constant c USING (n, head, i, token) GROUP BY ALL
        ), templates AS (
            SELECT n, head, t, list_concat(head, coalesce(rest, [])) AS template FROM masked LEFT JOIN rest USING (n, head, t)
        ), often AS (
            SELECT template FROM templates JOIN inside USING (n, head, t) WHERE 2 * len(list_filter(template, lambda x: x <> '<*>')) >= len(template)
            GROUP BY template HAVING count(DISTINCT doc_id) >= 10
        ), dropped AS (
            SELECT DISTINCT t FROM templates SEMI JOIN often USING (template)
        )
        SELECT doc_id, count(*) AS n_lines, count(d.t) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (d.t IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN dropped d ON lines.t = d.t GROUP BY doc_id
    """,
    "op6_quality_rules": r"""
        WITH common(lang, own) AS (
            VALUES ('en', ['the', 'of', 'and', 'to', 'in', 'a', 'is', 'that', 'for', 'it', 'as', 'was', 'with', 'be', 'by', 'on', 'are', 'this', 'from', 'not']),
                   ('de', ['der', 'die', 'und', 'in', 'den', 'von', 'zu', 'das', 'mit', 'sich', 'des', 'auf', 'für', 'ist', 'im', 'dem', 'nicht', 'ein', 'eine', 'als']),
                   ('fr', ['de', 'la', 'le', 'et', 'les', 'des', 'en', 'un', 'du', 'une', 'que', 'est', 'pour', 'qui', 'dans', 'par', 'sur', 'au', 'pas', 'plus']),
                   ('es', ['de', 'la', 'que', 'el', 'en', 'y', 'a', 'los', 'se', 'del', 'las', 'un', 'por', 'con', 'no', 'una', 'su', 'para', 'es', 'al'])
        ), docs AS (
            SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS h FROM docs, range(1, len(w) - 6) r(i)
        ), repeated AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
            FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM windows), range(0, 8) r(k) WHERE n > 1 GROUP BY doc_id
        ), s1 AS (SELECT doc_id, length(text) AS l0, regexp_replace(text, '[a-z]+', '', 'g') AS r FROM docs
        ), s2 AS (SELECT *, length(r) AS l1, regexp_replace(r, '[A-Z]+', '', 'g') AS r2 FROM s1
        ), s3 AS (SELECT *, length(r2) AS l2, regexp_replace(r2, '[0-9]+', '', 'g') AS r3 FROM s2
        ), s4 AS (SELECT *, length(r3) AS l3, regexp_replace(r3, '[ \t\n]+', '', 'g') AS r4 FROM s3
        ), s5 AS (SELECT *, length(r4) AS l4, regexp_replace(r4, '[.,;:!?''"()-]+', '', 'g') AS r5 FROM s4
        ), s6 AS (SELECT *, length(r5) AS l5, regexp_replace(r5, '[#*$%&|<>]+', '', 'g') AS r6 FROM s5
        ), s7 AS (SELECT *, length(r6) AS l6, length(regexp_replace(r6, '[^\x00-\x7F]+', '', 'g')) AS l7 FROM s6
        ), measured AS (
            SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                   [l0 - l1, l1 - l2, l2 - l3, l3 - l4, l4 - l5, l5 - l6, l6 - l7, l7] AS class_bins,
                   list_transform(own, lambda c: len(list_filter(w, lambda x: length(x) <= 6 AND lower(x) = c))) AS own_bins
            FROM docs d JOIN s7 USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN common USING (lang)
        ), bins AS (
            SELECT doc_id, lang, n_words, 'class' AS kind, unnest(class_bins) AS b, generate_subscripts(class_bins, 1) AS i FROM measured WHERE own_bins IS NOT NULL
            UNION ALL
            SELECT doc_id, lang, n_words, 'word', unnest(own_bins || [n_words - list_sum(own_bins)]),
                   generate_subscripts(own_bins || [n_words - list_sum(own_bins)], 1) FROM measured WHERE own_bins IS NOT NULL
        ), refs AS (
            SELECT lang, kind, i, sum(b) / sum(sum(b)) OVER (PARTITION BY lang, kind) AS q FROM bins WHERE n_words >= 80 GROUP BY lang, kind, i
        ), shares AS (
            SELECT doc_id, kind, q, b / greatest(sum(b) OVER (PARTITION BY doc_id, kind), 1) AS p FROM bins JOIN refs USING (lang, kind, i)
        ), distances AS (
            SELECT doc_id, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
                                                  + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2) / ln(2), 0)) AS d
            FROM shares GROUP BY doc_id, kind
        ), far AS (
            SELECT doc_id FROM distances JOIN measured USING (doc_id)
            WHERE n_words >= 80 AND d > CASE kind WHEN 'class' THEN 0.30 ELSE 0.32 END GROUP BY doc_id
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND f.doc_id IS NULL AS kept
        FROM measured LEFT JOIN far f USING (doc_id)
    """,
    "op7_sharding": """
        WITH RECURSIVE rows AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
            FROM documents
        ), buckets AS (
            SELECT 0 AS depth, 0::BIGINT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM rows
            UNION ALL
            SELECT depth, prefix, sum(n_bytes)::BIGINT, count(*)
            FROM (SELECT b.depth + 1 AS depth, r.place >> (59 - b.depth) AS prefix, n_bytes
                  FROM buckets b JOIN rows r ON r.place >> (60 - b.depth) = b.prefix
                  WHERE b.shard_bytes > 16777216 AND b.shard_docs > 1 AND b.depth < 60)
            GROUP BY depth, prefix
        )
        SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
               depth, shard_bytes, shard_docs
        FROM rows JOIN buckets ON place >> (60 - depth) = prefix AND (shard_bytes <= 16777216 OR shard_docs = 1)
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_mixing": """
        WITH docs AS (
            SELECT doc_id, CASE WHEN n < 5 THEN 'web' WHEN n < 10 THEN 'reference' WHEN n < 15 THEN 'news' ELSE 'forum' END AS domain,
                   coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
            FROM (SELECT *, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n FROM documents)
        ), leaves AS (
            SELECT domain, lang, source, sum(n_tokens)::BIGINT AS avail, sum(n_tokens)::DOUBLE * 2 AS supply FROM docs GROUP BY ALL
        ), top AS (
            SELECT domain, sum(supply) AS supply, floor(sum(sum(avail)) OVER () * 3 / 5)::DOUBLE AS budget,
                   CASE domain WHEN 'web' THEN 4 WHEN 'reference' THEN 3 WHEN 'news' THEN 2 ELSE 1 END::DOUBLE AS weight
            FROM leaves GROUP BY domain
        ), top_rate AS (
            SELECT *, (budget - coalesce(sum(supply) OVER (ORDER BY supply / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY supply / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
            FROM top
        ), top_alloc AS (
            SELECT domain, least(supply, max(rate) OVER () * weight) AS budget FROM top_rate
        ), mid AS (
            SELECT domain, lang, sum(supply) AS supply, any_value(a.budget) AS budget,
                   CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::DOUBLE AS weight
            FROM leaves JOIN top_alloc a USING (domain) GROUP BY domain, lang
        ), mid_rate AS (
            SELECT *, (budget - coalesce(sum(supply) OVER (PARTITION BY domain ORDER BY supply / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (PARTITION BY domain ORDER BY supply / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
            FROM mid
        ), mid_alloc AS (
            SELECT domain, lang, least(supply, max(rate) OVER (PARTITION BY domain) * weight) AS budget FROM mid_rate
        ), low_rate AS (
            SELECT l.*, (budget - coalesce(sum(supply) OVER (PARTITION BY domain, lang ORDER BY supply, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / count(*) OVER (PARTITION BY domain, lang ORDER BY supply, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
            FROM leaves l JOIN mid_alloc USING (domain, lang)
        ), low AS (
            SELECT domain, lang, source, avail, floor(least(supply, max(rate) OVER (PARTITION BY domain, lang)))::BIGINT AS target FROM low_rate
        ), budgets AS (
            SELECT *, CASE WHEN avail > 0 THEN target // avail ELSE 0 END AS epochs FROM low
        ), placed AS (
            SELECT d.*, target, epochs, target - epochs * avail AS rest,
                   ('0x' || substr(md5('17|' || epochs || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
            FROM docs d JOIN budgets USING (domain, lang, source)
        )
        SELECT doc_id, domain, lang, source, n_tokens, target,
               epochs + (rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) <= rest)::BIGINT AS copies
        FROM placed
    """,
}
