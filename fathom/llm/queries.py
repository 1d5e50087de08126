"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, covertree, exactdedup, langid, licences, merkle, mixing, simhash, substring, urlfilter
from fathom.llm.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES["op10_exact_dedup"] = op10_exact_dedup
ORACLE["op10_exact_dedup"] = r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
    SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES["op3_source_mix"] = op3_source_mix
ORACLE["op3_source_mix"] = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), c AS (
    SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + cap / weight * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= total AS capped FROM w
), t AS (
    SELECT *, CASE WHEN capped THEN cap::DOUBLE
              ELSE (total - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ()) * weight END AS target
    FROM c
), p AS (  -- blocks of one reading, and the slots that a source needs
    SELECT *, floor(target)::BIGINT AS take, greatest(1, ceil(source_size / greatest(1, round(source_size / 4096))))::BIGINT AS block FROM t
), q AS (
    SELECT *, ceil(source_size / block)::BIGINT AS blocks, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS whole,
           take - CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END * source_size AS rest FROM p
), r AS (
    SELECT *, (whole * blocks + ceil(rest / block))::BIGINT AS slots FROM q
), z AS (  -- shares of the unit interval
    SELECT *, sum(slots) OVER () AS every, (sum(slots) OVER (ORDER BY source NULLS LAST)) / (sum(slots) OVER ())::DOUBLE AS hi,
           (sum(slots) OVER (ORDER BY source NULLS LAST) - slots) / (sum(slots) OVER ())::DOUBLE AS lo FROM r
), pt AS (
    SELECT i AS position, ((i + 1) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM range((SELECT coalesce(sum(slots), 0)::BIGINT FROM r)) x(i)
), got AS (
    SELECT position, source, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS rank FROM pt JOIN z ON lo <= u AND u < hi AND slots > 0
), had AS (
    SELECT z.source, z.slots, z.every, count(got.position) AS had FROM z LEFT JOIN got ON z.source IS NOT DISTINCT FROM got.source GROUP BY ALL
), slot AS (
    SELECT got.* FROM got JOIN z ON z.source IS NOT DISTINCT FROM got.source WHERE rank < slots
    UNION ALL SELECT (every + rank)::BIGINT, source, rank FROM (SELECT source, every, unnest(range(had, slots)) AS rank FROM had WHERE slots > had)
), span AS (
    SELECT slot.position, z.source, (rank % blocks) * block AS s_lo,
           least((rank % blocks + 1) * block, CASE WHEN rank // blocks < whole THEN source_size ELSE rest END) AS s_hi
    FROM slot JOIN z ON z.source IS NOT DISTINCT FROM slot.source
), o AS (
    SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS take,
           (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0
            ELSE (take // source_size) * size + greatest(0, least(size, take % source_size - off)) END::BIGINT AS taken,
       (SELECT min(position) FROM span WHERE span.source IS NOT DISTINCT FROM o.source AND span.s_lo < o.off + o.size AND span.s_hi > o.off AND o.size > 0) AS first_slot
FROM o
"""

#: The rank file and the pattern that splits texts.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES["op5_bpe_round_trip"] = op5_bpe_round_trip


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


QUERIES["op6_simhash_groups"] = op6_simhash_groups


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op7_repeated_passages"] = op7_repeated_passages
ORACLE["op7_repeated_passages"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), n AS (
    SELECT r, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d
), win AS (
    SELECT n.r, n.i, sha256(array_to_string(d.w[n.i : n.i + 34], ' ')) AS h FROM n JOIN d ON n.r = d.r
), rep AS (
    SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), gone AS (
    SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM rep) GROUP BY r
), words AS (
    SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), g AS (
    SELECT DISTINCT r, unnest(ps) AS p FROM gone
), kept AS (
    SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS k FROM words
    LEFT JOIN g ON words.r = g.r AND words.p = g.p WHERE g.r IS NULL GROUP BY words.r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.k, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = langid.identify(docs, langid.train(docs))
    return told.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES["op9_language_id"] = op9_language_id


def op4_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES["op4_embedding_groups"] = op4_embedding_groups
ORACLE["op4_embedding_groups"] = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
    SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
), c AS (
    SELECT node, min(seen) AS component_id FROM r GROUP BY node
), n AS (
    SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.node
"""


def _hashed(text, modulus: int):
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % modulus


def op1_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages against a replica with planted damage: some records altered, some lost, some added."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    h = _hashed(F.col("page_id").cast("string"), 97)
    spoilt = F.when(h == 0, F.overlay(F.coalesce("html", F.lit("")), F.lit("�"), F.lit(3), F.lit(1))).otherwise(F.col("html"))
    replica = pages.where(h != 1).select("page_id", "url", spoilt.alias("html"))
    added = pages.where(h == 2).select((-F.col("page_id") - 1).alias("page_id"), "url", "html")
    return merkle.audit(pages, replica.unionByName(added)).select("page_id", "status", "offset", "range_start", "range_end")


QUERIES["op1_fixity_audit"] = op1_fixity_audit
ORACLE["op1_fixity_audit"] = r"""
WITH p AS (
    SELECT page_id, ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 97 AS h,
           -- WARC/1.1 and WARC-Type: resource, each with a line end; the line between; two line ends
           10 + 21 + coalesce(strlen('WARC-Target-URI: ' || url) + 2, 0) + coalesce(length('Content-Length: ' || strlen(html)) + 2, 0) + 2 + coalesce(strlen(html), 0) + 4 AS bytes
    FROM pages
), d AS (
    SELECT page_id, CASE h WHEN 0 THEN 'altered' WHEN 1 THEN 'missing' END AS status, bytes, bytes AS room FROM p
    UNION ALL SELECT -page_id - 1, 'extra', 0, bytes FROM p WHERE h = 2
), o AS (
    SELECT page_id, status, (sum(bytes) OVER w - bytes)::BIGINT AS "offset", (sum(room) OVER w - room)::BIGINT AS pos FROM d WINDOW w AS (ORDER BY page_id)
)
SELECT page_id, status, "offset", (pos >> 16) << 16 AS range_start, ((pos >> 16) << 16) + 65536 AS range_end FROM o WHERE status IS NOT NULL
"""

#: The planted list: days after this one.
LIST_START = "2024-01-01"


def op8_dated_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges all pages, fetched on days drawn from their ids, by a list whose dated entries are drawn from their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.timestamp_seconds(F.unix_timestamp(F.lit(LIST_START), "yyyy-MM-dd") + n * 86400)
    captures = pages.withColumn("fetched", day(_hashed(F.col("page_id").cast("string"), 366)))
    hosts = pages.select(urlfilter.host(F.col("url")).alias("domain")).where("domain is not null").distinct()
    entry = lambda action, salt, share: F.struct(
        F.lit(action).alias("action"), day(_hashed(F.concat(F.col("domain"), F.lit(salt)), 366)).alias("listed"), (_hashed(F.concat(F.col("domain"), F.lit(salt + "?")), 10) < share).alias("used")
    )
    drawn = hosts.select("domain", F.explode(F.array(entry("add", "a", 4), entry("add", "b", 3), entry("remove", "c", 5), entry("remove", "d", 2))).alias("e"))
    entries = drawn.where("e.used").select("domain", "e.action", "e.listed")
    out = urlfilter.judge(captures, entries)
    when = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("page_id", when("fetched").alias("fetched_on"), "host", "blocked", "matched_domain", when("listed_since").alias("since"))


QUERIES["op8_dated_url_filter"] = op8_dated_url_filter
ORACLE["op8_dated_url_filter"] = r"""
WITH c AS (
    SELECT DISTINCT page_id, url, ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 366 AS fetched,
           nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '\.$', ''), '') AS host
    FROM pages
), h AS (
    SELECT DISTINCT host AS domain FROM c WHERE host IS NOT NULL
), e AS (
    SELECT domain, s.a AS is_on, ('0x' || substr(md5(domain || s.salt), 1, 8))::BIGINT % 366 AS listed
    FROM h, (VALUES (true, 'a', 4), (true, 'b', 3), (false, 'c', 5), (false, 'd', 2)) AS s(a, salt, share)
    WHERE ('0x' || substr(md5(domain || s.salt || '?'), 1, 8))::BIGINT % 10 < s.share
), asked AS (
    SELECT page_id, url, fetched, host, array_to_string(string_split(host, '.')[i:], '.') AS domain
    FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host IS NOT NULL)
), state AS (  -- the last entry not after the fetch; of one day, a removal
    SELECT a.*, (SELECT e.is_on FROM e WHERE e.domain = a.domain AND e.listed <= a.fetched ORDER BY e.listed DESC, e.is_on LIMIT 1) AS is_on FROM asked a
), hit AS (
    SELECT *, (  -- listed since the first addition after the last removal
        SELECT min(e.listed) FROM e WHERE e.domain = state.domain AND e.listed <= state.fetched AND e.is_on
        AND e.listed > coalesce((SELECT max(r.listed) FROM e r WHERE r.domain = state.domain AND r.listed <= state.fetched AND NOT r.is_on), -1)
    ) AS since, row_number() OVER (PARTITION BY page_id, url ORDER BY length(domain) DESC) AS rn FROM state WHERE is_on
)
SELECT c.page_id, strftime(DATE '2024-01-01' + c.fetched::INT, '%Y-%m-%d') AS fetched_on, c.host, hit.domain IS NOT NULL AS blocked,
       hit.domain AS matched_domain, strftime(DATE '2024-01-01' + hit.since::INT, '%Y-%m-%d') AS since
FROM c LEFT JOIN hit ON c.page_id = hit.page_id AND c.url IS NOT DISTINCT FROM hit.url AND hit.rn = 1
"""


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "paragraph", F.sha2("body", 256).alias("body_sha256"), "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")


QUERIES["op2_licence_scan"] = op2_licence_scan
