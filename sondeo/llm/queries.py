"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, exact_dedup, html_text, license_scan, mixing, ngram_join, packing, periodic_runs, suffix_dedup, token_store, toxicity, whitening

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


# Target shares of the sources in documents per 100: curated sources count more than the crawl.
MIX_WEIGHTS = {"src0": 24, **{f"src{i}": 4 for i in range(1, 20)}}
MIX_OTHER = 1
_MIX_LIST = ", ".join(f"('{s}', {a})" for s, a in [*sorted({**MIX_WEIGHTS, mixing.OTHER: MIX_OTHER}.items())])


@register(
    "op1_mixing",
    f"""WITH RECURSIVE w(s, a) AS (VALUES {_MIX_LIST}),
d AS (SELECT doc_id, source, CASE WHEN source IN (SELECT s FROM w) THEN source ELSE '{mixing.OTHER}' END AS s,
             md5(concat_ws('|', doc_id::VARCHAR, source)) AS k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) - 1 AS rk FROM d),
n AS (SELECT s, count(*) AS c, (count(*) + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} AS blocks FROM d GROUP BY s),
cfg AS (SELECT list(s ORDER BY s) AS ss, list(a ORDER BY s) AS aa, list(blocks ORDER BY s) AS bb FROM n JOIN w USING (s)),
sched(slot, u, done, inph, pick) AS (
  SELECT 0::BIGINT, 0::BIGINT, list_transform(ss, lambda x: 0::BIGINT), list_transform(ss, lambda x: 0::BIGINT), 0::BIGINT FROM cfg
  UNION ALL
  SELECT slot + 1,
    CASE WHEN done[p] + 1 = bb[p] THEN 0 ELSE u + 1 END,
    list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END),
    list_transform(inph, lambda x, i: CASE WHEN done[p] + 1 = bb[p] THEN 0 WHEN i = p THEN x + 1 ELSE x END), p
  FROM (SELECT *, list_min(list_filter(list_transform(range(1, len(ss) + 1), lambda i:
          CASE WHEN done[i] < bb[i] AND (inph[i] * q) // aa[i] <= u THEN (((inph[i] + 1) * q + aa[i] - 1) // aa[i]) * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS p
        FROM (SELECT *, list_sum(list_transform(range(1, len(ss) + 1), lambda i: CASE WHEN done[i] < bb[i] THEN aa[i] ELSE 0 END))::BIGINT AS q FROM sched, cfg) WHERE q > 0)),
slots AS (SELECT slot - 1 AS slot, ss[pick] AS s, done[pick] - 1 AS block FROM sched, cfg WHERE pick > 0),
pos AS (SELECT slot, s, block, coalesce(sum(sz) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT slot, slots.s, block, least({mixing.BLOCK_ROWS}, c - block * {mixing.BLOCK_ROWS}) AS sz FROM slots JOIN n USING (s)))
SELECT doc_id, source, r.s AS mix_source, block AS mix_block, slot AS mix_slot, (before + rk % {mixing.BLOCK_ROWS})::BIGINT AS mix_position
FROM r JOIN pos ON r.s = pos.s AND rk // {mixing.BLOCK_ROWS} = block""",
)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs, MIX_WEIGHTS, MIX_OTHER)


@register("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


@register("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@register("op5_ann")
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@register("op4_token_store")
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


@register("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_rows(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@register(
    "op7_exact_dedup",
    r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT h, count(*) AS c FROM d GROUP BY h),
w AS (SELECT h, doc_id AS keep_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS r FROM d) WHERE r = 1)
SELECT doc_id, keep_id, c AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h) JOIN w USING (h)""",
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _license_sql() -> str:
    values = ", ".join(f"('{r['digest']}', '{r['license']}')" for r in license_scan.known_digests())
    canon = rf"regexp_replace(lower(part), '{license_scan.GRANT_BEGINS}', chr(10) || '\1', 'g')"
    canon = rf"trim(regexp_replace(regexp_replace({canon}, '{license_scan.COPYRIGHT_LINE}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' ')"
    for a, b in license_scan.SPELLINGS:
        canon = f"replace({canon}, '{a}', '{b}')"
    return f"""WITH k(h, license) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
u AS (SELECT rid, doc_id, 0 AS unit, text AS part FROM d
      UNION ALL SELECT rid, doc_id, 1 AS unit, unnest(string_split(text, chr(10))) AS part FROM d),
m AS (SELECT rid, doc_id, unit, license FROM (SELECT rid, doc_id, unit, sha256({canon}) AS h FROM u) JOIN k USING (h))
SELECT doc_id, max(CASE WHEN unit = 0 THEN license END) AS license, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses,
       count(*) FILTER (WHERE unit = 1) AS n_lines FROM m GROUP BY rid, doc_id"""


@register("op9_license_scan", _license_sql())
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


@register("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset"))


@register("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_period(table(spark, sf_dir, "documents"))
    return periodic_runs.digest_rows(periodic_runs.find_runs(docs))


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings"), k=32))


@register("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    digests = [F.sha2(F.col(a), 256).alias(b) for a, b in (("ids", "ids_sha256"), ("decoded", "decoded_sha256"))]
    return out.select("doc_id", "n_tokens", *digests)
