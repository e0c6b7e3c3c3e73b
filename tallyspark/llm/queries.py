"""The registered opN queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import boosted_rules, decontamination, factorisation, host_reputation, kmeans_tree, language, merge_dropout, merkle, repeats, simhash, token_counts, warc, whitening
from tallyspark.llm.manifest_sql import manifest_sql
from tallyspark.llm.scratch import scratch_path, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    manifest = stored(warc.write_archives(table(spark, sf_dir, "pages"), folder), "warc-manifest")
    return warc.read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tokens", "n_covered", "coverage", F.size("tiles").alias("n_tiles"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorisation.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"), length=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is that of the label of its id: bad if of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    judged = host_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = boosted_rules.judge(docs, boosted_rules.train(docs, table(spark, sf_dir, "labels"), "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text with merge-dropout: their number, a digest of their ids, and whether they decode to the text."""
    coded = merge_dropout.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), rate=0.1, seed=1)
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "lossless")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered rows, where 5 divides crc32 of the id, have their text in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = merkle.leaves(table(spark, sf_dir, "documents"), changes={"text": merkle.ascii_lower(F.col("text"))}, where=tampered)
    return merkle.verified(merkle.proofs(leaves)).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_decontamination": op2_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_language_id": op6_language_id,
        "op7_url_filters": op7_url_filters,
        "op8_quality_rules": op8_quality_rules,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_simhash": op10_simhash,
        "op11_nearest_neighbours": op11_nearest_neighbours,
        "op12_whitening": op12_whitening,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


OP5_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
windows AS (SELECT rid, i, word, count(*) OVER f AS n, md5(string_agg(word, ' ') OVER f) AS h FROM words
            WINDOW f AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
twice AS (SELECT h FROM windows WHERE n = 35 GROUP BY h HAVING count(*) > 1),
marked AS (SELECT rid, i, word, CASE WHEN n = 35 AND h IN (SELECT h FROM twice) THEN 1 ELSE 0 END AS starts FROM windows),
covered AS (SELECT rid, i, word, max(starts) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked),
summed AS (SELECT rid, sum(gone) AS n_removed, coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i), '') AS kept FROM covered GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN summed USING (rid)
"""


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * k}, 5))::BIGINT >> {bits}) & 31)::INT, 1)" for k in range(8) for bits in (15, 10, 5, 0))

OP1_SQL = f"""
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
digests AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM payloads),
named AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM digests)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM named
"""


def _strength(level: str) -> str:
    """Prior strength of a level's beta-binomial counts by moments, as a scalar subquery."""
    return f"""(SELECT CASE WHEN k < 2 OR k IS NULL OR b = 0 OR b = n OR room <= 0 OR rho <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, (1 - rho) / rho)) END FROM (
        SELECT *, CASE WHEN room > 0 THEN (s - m * m * n - m * (1 - m) * (k - 1)) / room ELSE 0 END AS rho FROM (
            SELECT *, m * (1 - m) * (n - q / n - (k - 1)) AS room FROM (
                SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS b, sum(n::DOUBLE * n) AS q, sum(bad::DOUBLE * bad / n) AS s, sum(bad)::DOUBLE / sum(n) AS m FROM {level} WHERE n > 0))))"""


OP7_SQL = f"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
outcomes AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM parsed LEFT JOIN outcomes USING (page_id) GROUP BY host),
labels_of AS (SELECT *, string_split(host, '.') AS p, CASE WHEN len(string_split(host, '.')) > 1 AND regexp_full_match(string_split(host, '.')[-1], '[a-z][a-z]') AND string_split(host, '.')[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS k FROM hosts),
split AS (SELECT host, n, bad, array_to_string(p[-(k + 1):], '.') AS domain, array_to_string(p[-k:], '.') AS suffix FROM labels_of),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM split GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
k AS (SELECT {_strength("suffixes")} AS ks, {_strength("domains")} AS kd, {_strength("hosts")} AS kh, (SELECT (sum(bad) + 1)::DOUBLE / (sum(n) + 2) FROM suffixes) AS base),
s AS (SELECT suffix, (ks * base + bad) / (ks + n) AS mean_s FROM suffixes, k),
d AS (SELECT domain, (kd * mean_s + bad) / (kd + n) AS mean_d FROM domains JOIN s USING (suffix), k),
h AS (SELECT host, (kh * mean_d + bad) / (kh + n) AS mean, kh + n AS weight FROM split JOIN d USING (domain), k),
judged AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 AS blocked FROM h),
ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN judged USING (host)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op7_url_filters": OP7_SQL, "op13_merkle_manifest": manifest_sql()}
