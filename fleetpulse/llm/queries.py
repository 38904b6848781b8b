"""One query for each operator, over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.bpe import bpe_encode
from fleetpulse.llm.exact_dedup import exact_dedup
from fleetpulse.llm.hpy_lm import hpy_score
from fleetpulse.llm.html_text import extract_main_text
from fleetpulse.llm.jaccard_join import jaccard_classes
from fleetpulse.llm.language_id import LanguageProfiles
from fleetpulse.llm.line_dedup import dedup_lines
from fleetpulse.llm.quality_rules import BASE, judge_quality
from fleetpulse.llm.resample import importance_resample
from fleetpulse.llm.secret_scan import scan_secrets
from fleetpulse.llm.shard_tree import assign_shards
from fleetpulse.llm.sharded_lloyd import cluster_vectors
from fleetpulse.llm.source_mix import mix_sources

#: Vocabulary file of the token queries, as public_tokenizers names it.
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int) -> Column:
    """crc32 of the identifier as text, modulo the divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).withColumn("n_chars", F.length("text").cast("bigint"))


def op3_pitman_yor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = hpy_score(docs, remainder(10) != 0)
    return scored.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "text_id", "n_text_links", "n_links", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = LanguageProfiles.fit(docs.filter(remainder(3) != 1))
    return learned.predict(docs.select("doc_id", (remainder(3) == 1).alias("held_out"), "text"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "block", "release", "deadline", "slot", "on_target")


def op9_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return done.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_html_text, op3_pitman_yor_score, op4_exact_dedup, op5_secret_scan, op6_jaccard_join, op7_language_id,
        op8_source_mix, op9_shard_tree, op10_bpe, op11_importance_resample, op12_sharded_lloyd, op13_line_dedup,
    )
}


def lloyd_sql(rounds: int = 10) -> str:
    """The rounds one after the other; a mean's floor is taken in whole numbers."""
    steps = ["""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY drawn, q) - 1 AS k, q AS c
            FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS drawn, q FROM kept ORDER BY drawn, q LIMIT 8))"""]
    for n in range(rounds + 1):
        steps.append(f"""
        a{n} AS MATERIALIZED (
            SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
                SELECT r, k, list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT AS d FROM kept, c{n}) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
        c{n + 1} AS MATERIALIZED (
            SELECT o.k, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN (
                SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
                    SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
                        SELECT a.k, unnest(v.q) AS x, unnest(range(64)) AS i FROM a{n} a JOIN kept v USING (r)) GROUP BY k, i) GROUP BY k) m ON m.k = o.k)""")
    return ",".join(steps) + f"""
        SELECT v.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
               (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN kept v USING (r) JOIN c{rounds} c ON c.k = a.k"""


SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_jaccard_join": """
        WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS tid, count(*) AS copies FROM documents GROUP BY 1),
        words AS (SELECT tid, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM texts),
        grams AS (SELECT tid, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS gram FROM words),
        sizes AS (SELECT tid, count(*) AS n FROM grams GROUP BY 1),
        common AS (SELECT a.tid AS x, b.tid AS y, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.tid <> b.tid GROUP BY 1, 2),
        links AS (SELECT x, y FROM common JOIN sizes s ON s.tid = x JOIN sizes z ON z.tid = y WHERE c::DOUBLE / (s.n + z.n - c) >= 0.8),
        reach(tid, other) AS (SELECT tid, tid FROM texts UNION SELECT r.tid, l.y FROM reach r JOIN links l ON l.x = r.other),
        classes AS (SELECT tid, min(other) AS class_id FROM reach GROUP BY 1),
        counts AS (SELECT x AS tid, count(*) AS links, sum(copies) AS linked FROM links JOIN texts ON texts.tid = y GROUP BY 1)
        SELECT d.doc_id, c.class_id, t.tid AS text_id, coalesce(n.links, 0)::BIGINT AS n_text_links,
               (t.copies - 1 + coalesce(n.linked, 0))::BIGINT AS n_links, d.doc_id = c.class_id AS kept
        FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN classes c ON c.tid = t.tid LEFT JOIN counts n ON n.tid = t.tid""",
    "op8_source_mix": """
        WITH RECURSIVE docs AS (
            SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS hashed
            FROM documents),
        placed AS (SELECT doc_id, source,
                          coalesce(sum(size) OVER (PARTITION BY source ORDER BY hashed, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 262144 AS block
                   FROM docs),
        totals AS (SELECT source, sum(size)::BIGINT AS total FROM docs GROUP BY 1),
        shares AS (SELECT source, total, greatest(1, round(pow(total, 0.5) / sum(pow(total, 0.5)) OVER () * 1000))::BIGINT AS units,
                          row_number() OVER (ORDER BY coalesce('s' || source, '')) AS j FROM totals),
        listed AS (SELECT list(units ORDER BY j) AS u, sum(units)::BIGINT AS period FROM shares),
        picks(slot, state, j, nth) AS (
            SELECT -1::BIGINT, list_transform(u, lambda x: 0::BIGINT), 0::BIGINT, 0::BIGINT FROM listed
            UNION ALL
            SELECT slot, list_transform(state, lambda n, k: CASE WHEN k = j THEN n + 1 ELSE n END), j, state[j] FROM (
                SELECT p.slot + 1 AS slot, p.state, list_sort(list_filter(list_transform(u, lambda x, k:
                    CASE WHEN state[k] * period // x <= p.slot + 1 THEN struct_pack(d := ((state[k] + 1) * period + x - 1) // x, k := k) END),
                    lambda y: y IS NOT NULL))[1].k AS j
                FROM picks p, listed WHERE p.slot + 1 < period)),
        pattern AS (SELECT slot, j, nth FROM picks WHERE slot >= 0),
        ends AS (SELECT min(((total + 262143) // 262144) // units * period + p.slot) AS first_empty
                 FROM shares s, listed, pattern p WHERE p.j = s.j AND p.nth = ((total + 262143) // 262144) % units)
        SELECT d.doc_id, d.source, d.block, d.block * period // s.units AS release, ((d.block + 1) * period + s.units - 1) // s.units AS deadline,
               d.block // s.units * period + p.slot AS slot, d.block // s.units * period + p.slot < first_empty AS on_target
        FROM placed d JOIN shares s ON s.source IS NOT DISTINCT FROM d.source JOIN pattern p ON p.j = s.j AND p.nth = d.block % s.units, listed, ends""",
    "op12_sharded_lloyd": lloyd_sql(),
    "op13_line_dedup": """
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id < c.last AS gone FROM keyed k LEFT JOIN common c USING (key))
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r""",
}
