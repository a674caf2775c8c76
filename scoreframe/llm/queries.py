"""The queries of the operators, with their SQL where DuckDB can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.audit import audit_filters
from scoreframe.llm.common import documents, held
from scoreframe.llm.exact import exact_duplicates
from scoreframe.llm.extract import extract_main_text
from scoreframe.llm.jaccard import jaccard_components
from scoreframe.llm.language import identify_language
from scoreframe.llm.latent import find_contamination
from scoreframe.llm.licenses import scan_licenses
from scoreframe.llm.lines import dedup_lines
from scoreframe.llm.lm import score_texts
from scoreframe.llm.mix import mix_sources
from scoreframe.llm.packing import pack
from scoreframe.llm.toxicity import score_toxicity
from scoreframe.llm.trie import prefix_trie, rebuilt_conversations

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(rf"""
    WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM texts),
    keys AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                                 '{_UPPER}', '{_LOWER}') AS key FROM lines),
    shared AS (SELECT key, min(doc_id) AS first FROM keys WHERE length(key) >= 10
               GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    marked AS (SELECT k.*, s.first IS NOT NULL AND s.first <> k.doc_id AS dropped
               FROM keys k LEFT JOIN shared s USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
""")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(documents(spark, folder))
    digest = F.sha2("kept_text", 256).alias("kept_sha256")
    return found.select("doc_id", "n_lines", "n_dropped", digest)


@query()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = identify_language(documents(spark, folder), ~held("doc_id", 3, 1))
    return found.select("doc_id", held("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


# The contract's columns only: the labels and the score beyond the fixed phrases are the
# method's own, so SQL has no counterpart of the whole result.
@query()
def op3_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(documents(spark, folder)).drop("spans")


@query()
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{folder}/pages.parquet"))


@query()
def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    found = score_texts(documents(spark, folder), ~held("doc_id", 10, 0))
    return found.withColumn("held_out", held("doc_id", 10, 0))


@query()
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder))


@query(r"""
    WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
                   FROM documents),
    found AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY body)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
    FROM texts JOIN found USING (body)
""")
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder))


@query()
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), TOKENIZER)


@query()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = documents(spark, folder).select("doc_id", "text")
    found = score_toxicity(docs, labels, ~held("doc_id", 5, 0))
    return found.select(
        "doc_id",
        held("doc_id", 5, 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = find_contamination(documents(spark, folder), benchmark)
    return found.drop("matches")


@query(r"""
    WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
    worded AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM texts),
    firsts AS (SELECT body, min(coalesce(doc_id, 9223372036854775807)) AS first FROM texts GROUP BY body),
    marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad
              FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
                      [len(words) < 200,
                       100 * len(list_distinct(words)) < 50 * len(words),
                       100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 2 * length(body),
                       regexp_matches(body, '[#$%&*|]'),
                       coalesce(doc_id, 9223372036854775807) > first] AS fails
               FROM worded JOIN firsts USING (body) LEFT JOIN marks USING (doc_id)),
    cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failed GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
    orders AS (SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order
               FROM letters a, letters b, letters c, letters d, letters e
               WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
    steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
                     ascii(substr(filter_order, step, 1)) - 64 AS place,
                     [ascii(x) - 64 for x in string_split(substr(filter_order, 1, step - 1), '') if x <> ''] AS earlier
              FROM orders, (SELECT unnest(range(1, 6)) AS step)),
    ran AS (SELECT part, filter_order, step, letter, n, good, bad, fails[place] AS fail,
                   len([i for i in earlier if fails[i]]) > 0 AS gone, len([x for x in fails if x]) = 1 AS alone
            FROM cells, steps),
    counted AS (SELECT part, filter_order, step, letter,
                       sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept,
                       sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS removed,
                       sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS redundant,
                       sum(CASE WHEN fail AND alone THEN n ELSE 0 END) AS unique_fails,
                       sum(CASE WHEN fail AND NOT gone THEN good ELSE 0 END) AS good_lost,
                       sum(CASE WHEN fail AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
                FROM ran GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept,
           CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
    FROM counted
""")
def op11_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return audit_filters(documents(spark, folder), labels)


@query(r"""
    WITH turns AS (SELECT conv_id, turn, length(coalesce(text, '')) AS points,
                          substr(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''),
                                               coalesce(text, ''))), 1, 32) AS id
                   FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({'id': id, 'points': points} ORDER BY turn NULLS FIRST, id) AS t,
                   -- crc32 of the decimal id, bit by bit
                   xor(4294967295, list_reduce(
                       [CAST(ascii(c) AS BIGINT) for c in string_split(CAST(conv_id AS VARCHAR), '')],
                       lambda a, c: list_reduce(range(8),
                           lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END,
                           xor(a, c)), 4294967295)) % 6 AS h
            FROM turns GROUP BY conv_id),
    rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t
                FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
    depths AS (SELECT *, unnest(range(0, len(t) + 1)) AS depth FROM rebuilt),
    met AS (SELECT conv_id, depth, array_to_string([x.id for x in t[1:depth]], '') AS node,
                   array_to_string([x.id for x in t[1:depth - 1]], '') AS above,
                   coalesce(t[depth].points, 0) AS points, len(t) = depth AS ending
            FROM depths),
    nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(above) AS above,
                     count(*) AS n_convs, (count(*) - 1) * min(points) AS saved,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                                     FILTER (ending), '')) AS ends_sha256
              FROM met GROUP BY node),
    below AS (SELECT a.node, count(*) FILTER (b.depth = a.depth + 1) AS n_children,
                     count(*) FILTER (NOT EXISTS (SELECT 1 FROM nodes c
                                                  WHERE c.depth > 0 AND c.above = b.node)) AS n_leaves,
                     sum(b.saved) AS saved_tokens
              FROM nodes a JOIN nodes b ON starts_with(b.node, a.node) GROUP BY a.node)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves,
           CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN below USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.above
""")
def op12_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    heads = F.crc32(F.col("conv_id").cast("string")) % 6
    return prefix_trie(rebuilt_conversations(conversations, heads))


@query(r"""
    WITH docs AS (SELECT doc_id, coalesce(concat('0', source), '1') AS key,
                         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                         CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''), ':',
                                                             coalesce(text, ''))), 1, 15)) AS BIGINT) AS ord
                  FROM documents),
    sources AS (SELECT key, CAST(sum(size) AS BIGINT) AS words, count(*) AS n,
                       row_number() OVER (ORDER BY key) AS place FROM docs GROUP BY key),
    weighed AS (SELECT *, 2 * words AS bound, CAST([3, 1, 2][(place - 1) % 3 + 1] AS DOUBLE) AS weight,
                       CAST(sum(words) OVER () AS BIGINT) AS whole FROM sources),
    levels AS (SELECT *, bound / weight AS ratio,
                      (150 * whole / 100 - CAST(sum(bound) OVER w AS BIGINT) + bound)
                      / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level
               FROM weighed WINDOW w AS (ORDER BY bound / weight, place ROWS UNBOUNDED PRECEDING)),
    free AS (SELECT arg_min(level, (ratio, place)) AS level FROM levels WHERE bound > weight * level),
    targets AS (SELECT l.key, l.words, l.n, l.place, CAST(floor(150 * whole / 100 / 16 + 0.5) AS BIGINT) AS seats,
                       coalesce(least(CAST(bound AS DOUBLE), weight * f.level), CAST(bound AS DOUBLE)) AS target
                FROM levels l, free f),
    ranked AS (SELECT place, k, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS rank
               FROM (SELECT *, unnest(range(0, seats)) AS k FROM targets)),
    quotas AS (SELECT t.*, CAST(ceil(n / 8192) AS BIGINT) AS shards, coalesce(q.quota, 0) AS quota
               FROM targets t LEFT JOIN (SELECT place, count(*) AS quota FROM ranked WHERE rank <= seats
                                         GROUP BY place) q USING (place)),
    dealt AS (SELECT d.*, q.words AS source_size, target, quota, ord % shards AS shard
              FROM docs d JOIN quotas q USING (key)),
    cells AS (SELECT key, shard, min(quota) AS quota, CAST(sum(size) AS BIGINT) AS words FROM dealt GROUP BY key, shard),
    won AS (SELECT key, shard, k, quota,
                   row_number() OVER (PARTITION BY key ORDER BY words / (2 * k + 1) DESC, shard, k) AS rank
            FROM (SELECT *, unnest(range(0, quota)) AS k FROM cells)),
    shares AS (SELECT c.key, c.shard, greatest(1, (words + 15) // 16) AS blocks,
                      least(coalesce(s.quota, 0), 2 * ((words + 15) // 16)) AS quota,
                      CAST(concat('0x', substr(md5(concat_ws(':', 'mix', c.key, c.shard)), 1, 15)) AS BIGINT) AS seeded
               FROM cells c LEFT JOIN (SELECT key, shard, count(*) AS quota FROM won WHERE rank <= quota
                                       GROUP BY key, shard) s ON s.key = c.key AND s.shard = c.shard),
    placed AS (SELECT d.doc_id, d.size, d.source_size, d.target, s.blocks, s.quota, seeded % blocks AS start,
                      CAST(sum(size) OVER (PARTITION BY d.key, d.shard ORDER BY ord, doc_id NULLS FIRST, size
                                           ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p
               FROM dealt d JOIN shares s ON s.key = d.key AND s.shard = d.shard),
    edges AS (SELECT *, [p, p - size] AS ends FROM placed),
    upto AS (SELECT *, [(quota // blocks) * e + 16 * (((e // 16) * (quota % blocks) + start) // blocks)
                        + (e % 16) * ((((e // 16 + 1) * (quota % blocks) + start) // blocks)
                                      - (((e // 16) * (quota % blocks) + start) // blocks)) for e in ends] AS g
             FROM edges)
    SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN g[1] - g[2] ELSE 0 END AS taken FROM upto
""")
def op13_mix_to_targets(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(documents(spark, folder))
