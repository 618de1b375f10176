"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, exact_dedup, imatch, katz, language, packing, quality, secrets, simhash, toxicity
from postmill.llm.common import documents, fold


def _held_out(remainder: int):
    return F.coalesce(fold() == remainder, F.lit(False)).alias("held_out")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(documents(spark, sf_dir)))


def _places_sql(kind: int, source: str, pattern: str, group: int = 0) -> str:
    """Rows (doc_id, source, kind, start, stop, value) of the matches: gaps and matches before add up to places."""
    sizes = "coalesce(list_sum(list_transform({}, lambda z: length(z))), 0)"
    return f"""SELECT doc_id, source, {kind} AS kind, start, start + length(m[i]) AS stop, g[i] AS value FROM (
      SELECT *, {sizes.format('s[1:i]')} + {sizes.format('m[1:i-1]')} AS start FROM (
        SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, source, regexp_extract_all(x, '{pattern}') AS m, regexp_extract_all(x, '{pattern}', {group}) AS g,
                 string_split_regex(x, '{pattern}') AS s FROM {source} WHERE regexp_matches(x, '{pattern}'))))"""


_QUOTED = secrets.ASSIGN.replace("'", "''")
_LISTED = "string_agg(['assign', 'access', 'hex', 'owner'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
OP7_SQL = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
base AS (
  SELECT * FROM ({_places_sql(0, 't', _QUOTED, 2)}) WHERE length(value) >= 8
  UNION ALL {_places_sql(1, 't', secrets.ACCESS)}
  UNION ALL {_places_sql(2, 't', secrets.HEX)}),
candidates AS (
  SELECT * FROM ({_places_sql(3, 't', secrets.CANDIDATE)})
  WHERE regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
    AND len(list_distinct(string_split(value, ''))) >= {secrets.MIN_DISTINCT}),
held AS (
  SELECT value, count(*) AS owners, sum(n) AS repositories FROM (
    SELECT value, owner, count(*) AS n FROM (
      SELECT c.value, t.x, min(c.source) AS owner FROM candidates c JOIN t USING (doc_id) GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1),
verdicts AS (
  SELECT value, owners <= {secrets.MAX_OWNERS} AND repositories <= {secrets.MAX_REPOSITORIES} * owners AS live FROM held),
added AS (
  SELECT c.* FROM candidates c JOIN verdicts USING (value) WHERE live AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c.stop AND b.stop > c.start)),
per_base AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex, {_LISTED} AS listed FROM base GROUP BY 1),
per_all AS (SELECT doc_id, {_LISTED} AS listed FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY 1),
copied AS (SELECT doc_id, count(*) AS n FROM candidates JOIN verdicts USING (value) WHERE NOT live GROUP BY 1)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(a.listed, '') AS spans, coalesce(n, 0) AS n_examples
FROM t LEFT JOIN per_base b USING (doc_id) LEFT JOIN per_all a USING (doc_id) LEFT JOIN copied USING (doc_id)
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit_dictionaries(docs.filter(fold() != 0))
    return language.identify(docs, model).select("doc_id", _held_out(0), "lang_pred", "score", "rejected")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = quality.fit_quality(docs, _labels(spark, sf_dir).filter(fold() != 0))
    return quality.score_quality(docs, net).select("doc_id", _held_out(0), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, _labels(spark, sf_dir).filter(fold() != 0))
    return toxicity.score_toxicity(docs, model).select("doc_id", _held_out(0), "toxic", "score", "severity", "grade")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("train", fold() != 1)
    found = katz.score_documents(docs)
    return found.select("doc_id", _held_out(1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _discounts_sql(counts: str) -> str:
    """(r, d) for r = 1..5 from the counts of counts of a table with a column c."""
    n = ", ".join(f"count(*) FILTER (WHERE c = {r})::DOUBLE" for r in range(1, 7))
    return f"""SELECT r, CASE WHEN good > 0 AND good <= 1 THEN good ELSE 1 - a / r END AS d FROM (
      SELECT r, CASE WHEN n[r] > 0 AND tail < 1 THEN ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail) ELSE -1 END AS good,
             CASE WHEN n[1] > 0 AND n[2] > 0 THEN n[1] / (n[1] + 2 * n[2]) ELSE 0.5 END AS a FROM (
        SELECT n, CASE WHEN n[1] > 0 THEN 6 * n[6] / n[1] ELSE 0 END AS tail FROM (SELECT [{n}] AS n FROM {counts} WHERE c > 0)),
        (SELECT unnest(range(1, 6))::INT AS r))"""


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
    4294967295)"""
#: The end of a document is the empty word, which is also before the first one.
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_CRC} % 5 = 1, false) AS held_out,
                  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), '') AS w
           FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS b, unnest(list_prepend('', w)[1:len(w)]) AS a FROM d),
uni AS (SELECT b AS w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
bi AS (SELECT a, b, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1, 2),
d1 AS ({_discounts_sql('uni')}),
d2 AS ({_discounts_sql('bi')}),
total AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v, 1 / (coalesce(sum(c), 0) + 1.0) AS least,
                 CASE WHEN sum(c) > 0 THEN coalesce(sum((1 - d) * c), 0)::DOUBLE / sum(c) ELSE 1.0 END AS lost FROM uni LEFT JOIN d1 ON r = c),
model AS (SELECT *, greatest(lost, least) AS unknown, CASE WHEN lost < least AND lost < 1 THEN (1 - least) / (1 - lost) ELSE 1.0 END AS scale FROM total),
p1 AS (SELECT w, c, scale * coalesce(d, 1.0) * c / n AS p FROM uni LEFT JOIN d1 ON r = c, model),
seen AS (SELECT a, b, coalesce(d, 1.0) * bi.c / u.c AS p, l.p AS lower, u.c AS c1 FROM bi LEFT JOIN d2 ON r = bi.c
         JOIN uni u ON u.w = a JOIN p1 l ON l.w = b),
ctx AS (SELECT a, c1, sum(p) AS mass, greatest(1 - sum(p), 1 / (c1 + 1.0)) AS remain, 1 - sum(lower) AS rest FROM seen GROUP BY 1, 2),
scored AS (
  SELECT t.doc_id, t.held_out, u.c, round(log10((coalesce(u.c, 0) + 0.5) / (n + 0.5 * (v + 1))) * 1e7)::BIGINT AS base,
         round(log10(CASE WHEN s.b IS NOT NULL THEN s.p * ((1 - x.remain) / x.mass)
                          WHEN x.a IS NOT NULL THEN x.remain / greatest(x.rest, 1e-300) * coalesce(u.p, unknown) ELSE coalesce(u.p, unknown) END) * 1e7)::BIGINT AS p
  FROM t CROSS JOIN model LEFT JOIN p1 u ON u.w = t.b LEFT JOIN ctx x ON x.a = t.a LEFT JOIN seen s ON s.a = t.a AND s.b = t.b)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, sum(base) / 1e7 AS base_score, sum(p) / 1e7 AS score
FROM scored, model GROUP BY 1, 2
"""


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_imatch": op5_imatch,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_katz": op10_katz,
}

ORACLE_SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op7_secrets": OP7_SQL,
    "op10_katz": OP10_SQL,
}
