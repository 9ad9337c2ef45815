"""The collection operators as queries over the given tables, with SQL texts where SQL can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import bpe, decontam, exact_dedup, langid, lexical, line_dedup, packing, periodic, quality, simhash, suffix_dedup, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RULES = [
    url_filter.host_rule("net/", "block"), url_filter.host_rule("example.net/en/", "allow"),
    url_filter.host_rule("example.com/de/", "block"), url_filter.host_rule("org/fr/", "allow"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, text: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if text is not None:
            SQL[name] = text
        return run

    return wrap


def tokenizer(name: str = "byte_bpe_50k.json") -> dict[str, str]:
    import public_tokenizers

    return {"path": public_tokenizers.path(name)}


@query("op1_url_filter", r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


@query("op2_line_dedup", """
WITH own AS (SELECT doc_id, md5(coalesce(text, '')) AS th, text FROM documents),
lines AS (
  SELECT doc_id, th, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM (SELECT DISTINCT * FROM own)),
weighed AS (SELECT *, len(regexp_split_to_array(trim(line), ' +')) AS words FROM lines WHERE trim(line) <> ''),
placed AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id, th ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM weighed),
runs AS (
  SELECT 'from' AS side, doc_id, th, pos, max(pos) OVER r AS last, sum(words) OVER r AS total, list(line) OVER r AS run
  FROM placed WINDOW r AS (PARTITION BY doc_id, th ORDER BY before RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING)
  UNION ALL
  SELECT 'upto' AS side, doc_id, th, min(pos) OVER r AS pos, pos AS last, sum(words) OVER r AS total, list(line) OVER r AS run
  FROM placed WINDOW r AS (PARTITION BY doc_id, th ORDER BY before + words RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)),
later AS (
  SELECT doc_id, th, pos, last FROM runs WHERE total >= 30 QUALIFY row_number() OVER (PARTITION BY side, run ORDER BY doc_id, th, pos) > 1),
gone AS (SELECT DISTINCT doc_id, th, unnest(range(pos, last + 1)) AS pos FROM later),
cut AS (
  SELECT l.doc_id, l.th, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.th = l.th AND g.pos = l.pos GROUP BY ALL)
SELECT own.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, cut.text FROM own LEFT JOIN cut ON cut.doc_id = own.doc_id AND cut.th = own.th
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query("op3_warc", r"""
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM own
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"), min_bytes=0)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False))
    model = langid.learn(docs.filter(~held))
    return langid.identify(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), size=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(langid.fold("doc_id", 3) == 1, F.lit(False))
    model = quality.learn(docs, table(spark, sf_dir, "labels").filter(~held))
    return quality.score(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer())


@query("op10_exact_dedup", """
WITH own AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
ranked AS (
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(body) AS text_sha256 FROM own WINDOW w AS (PARTITION BY body))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op11_lexical_search", r"""
WITH read AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM read WHERE len(terms) > 0),
sizes AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM docs),
counts AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL),
items AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
wanted AS (SELECT i, item_id, unnest(list_distinct(terms)) AS term FROM items),
held AS (SELECT term, count(*)::BIGINT AS df FROM counts WHERE term IN (SELECT term FROM wanted) GROUP BY term),
weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM held, sizes),
scored AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM wanted JOIN weighed USING (term) JOIN counts USING (term) JOIN docs USING (r), sizes GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op12_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), **path), **path)
    n = F.size("ids").cast("bigint").alias("n_tokens")
    return out.select("doc_id", n, F.sha2("decimal", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = periodic.with_tail_repeated(F.col("text"), F.crc32(F.col("doc_id").cast("string")))
    out = periodic.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", changed.alias("text")), min_length=6, min_periods=4)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = out.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(periodic.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
