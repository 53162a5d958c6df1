"""One registered query per operator, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorebook.llm import counts, decontam, langid, mixing, packing, quality, resample, runs, search, simhash, spans, tokens, urls

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
ORACLE["op6_source_mixing"] = f"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM sizes GROUP BY source),
cap AS (SELECT *, idx % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM src),
lev AS (SELECT *, (total - sum(cap) OVER (ORDER BY cap / weight, idx ROWS UNBOUNDED PRECEDING) + cap)
        / sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM cap),
free AS (SELECT *, max(CASE WHEN cap > level * weight THEN level END) OVER () AS lam FROM lev),
tgt AS (SELECT source, idx, source_size, total, CASE WHEN cap > level * weight THEN lam * weight ELSE cap END::DOUBLE AS target,
        greatest(1, least(64, total // 65536))::BIGINT AS block, ceil(docs / 10000)::BIGINT AS shards FROM free),
quotients AS (SELECT idx, target / (2 * s + 1) AS q, s FROM tgt, range(0, (SELECT (3 * max(source_size) // max(block) + 9)::BIGINT FROM tgt)) r(s)
              WHERE target > 0 AND s <= 3 * source_size / block + 8),
seats AS (SELECT idx, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY q DESC, idx, s) AS rank FROM quotients)
          WHERE rank <= (SELECT round(max(total) / max(block)) FROM tgt) GROUP BY idx),
laid AS (SELECT d.doc_id, d.source, d.size, t.idx, t.source_size, t.target, t.block, {_HASH.format("'17:' || coalesce(doc_id::VARCHAR, '~')")} AS h,
         {_HASH.format("'17:' || coalesce(doc_id::VARCHAR, '~')")} % t.shards AS shard FROM sizes d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source),
shards AS (SELECT idx, shard, sum(size)::BIGINT AS words, max(block) AS block FROM laid GROUP BY idx, shard),
sq AS (SELECT idx, shard, words / (2 * s + 1) AS q, s FROM shards, range(0, (SELECT (3 * max(words) // max(block) + 9)::BIGINT FROM shards)) r(s)
       WHERE words > 0 AND s <= 3 * words / block + 8),
got AS (SELECT idx, shard, count(*) AS quota FROM (SELECT sq.*, seats.quota, row_number() OVER (PARTITION BY idx ORDER BY q DESC, shard, s) AS rank
        FROM sq JOIN seats USING (idx)) WHERE rank <= quota GROUP BY idx, shard),
quotas AS (SELECT s.idx, s.shard, ceil(s.words / s.block)::BIGINT AS blocks, least(coalesce(g.quota, 0), 3 * ceil(s.words / s.block)::BIGINT) AS quota,
           {_HASH.format("'17:' || s.idx || ':' || s.shard")} AS hs FROM shards s LEFT JOIN got g USING (idx, shard)),
perm AS (SELECT *, greatest(blocks, 1) AS n, [2147483647, 2147483629, 2147483587, 2147483579][(hs % 4 + 1)::BIGINT] % greatest(blocks, 1) AS step,
         hs % greatest(blocks, 1) AS shift FROM quotas),
cum AS (SELECT *, sum(size) OVER (PARTITION BY idx, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS x1 FROM laid)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN (quota // n) * size + coalesce(list_sum([
  CASE WHEN (b * step + shift) % n < quota % n THEN least(x1, (b + 1) * block) - greatest(x1 - size, b * block) ELSE 0 END
  FOR b IN range((x1 - size) // block, (x1 - 1) // block + 1)]), 0) ELSE 0 END)::BIGINT AS taken
FROM cum JOIN perm USING (idx, shard)
"""


@_query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages"), rules)


ORACLE["op9_url_filters"] = """
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                 ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, coalesce(arg_max(verdict, length(rhost || rpath)), 'allow') AS verdict
FROM (SELECT u.*, row_number() OVER () AS n FROM u) LEFT JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY n, page_id, host, path
"""


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


@_query
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@_query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.over_limit(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query
def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents"))


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 as a query against all documents."""
    docs = _table(spark, sf_dir, "documents")
    found = search.top_k(search.build_index(docs), docs.where("doc_id % 100 = 0"))
    return found.selectExpr("query_id", "rank", "doc_id", "round(score, 6) AS score")


ORACLE["op4_topk_search"] = """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM lens) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term, n),
hits AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
         FROM tf q JOIN tf d USING (term) JOIN idf USING (term) JOIN lens ON lens.doc_id = d.doc_id, stats
         WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM hits) WHERE rank <= 10
"""


@_query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.with_periodic_tails(_table(spark, sf_dir, "documents"))))


@_query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))
