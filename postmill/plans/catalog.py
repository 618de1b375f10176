"""The test tables seen as mail: messages, conversations, classifications, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.privacy import Security
from postmill.limits import UNLIMITED, PackLimits
from postmill.operators.rules import Assignment, Rule
from postmill.session import spread

RULES = (
    Rule("building", from_domain=("building.example.com",),
         assign=Assignment("Clients/Building & Co", "medium", "high", "metadata-only")),
    Rule("no-effect", subject_contains=("the",)),
    Rule("early", from_contains=("customer.00000001",), assign_hint=Assignment("clients/early", None, None, "scrubbed")),
    Rule("german", subject_contains=(" und ",), assign_hint=Assignment("lang/german", "low", None, "exclude")),
    Rule("tion", subject_contains=("tion",), assign=Assignment("topics/tion", "low", "low", "scrubbed")),
)
ALL_FLAGS = Security("scrubbed", True, True, True, True, True, True)
LIMITS = PackLimits("test", 40, 10, 30, 4_000, 3_000, UNLIMITED, UNLIMITED, 12)


#: Tables with whole texts: worth dealing out if their files make few splits.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def recipients(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Sorted distinct supplier addresses of each order, or of those in ``orders`` (its first column)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    if orders is not None:
        lines = lines.join(orders, F.col("l_orderkey") == F.col(orders.columns[0]), "left_semi")
    lines = lines.distinct()
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    address = F.concat(F.lit("supplier."), F.col("l_suppkey").cast("string"), F.lit("@n"),
                       F.col("s_nationkey").cast("string"), F.lit(".example.net"))
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(address)).alias("recipients"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, their orders and customers as messages; recipients from the order's suppliers.

    What is short is joined first, for the orders that have a document, so texts go through one join.
    """
    docs = table(spark, sf_dir, "documents")
    ids = docs.select(F.col("doc_id").alias("_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(
        ids, F.col("o_orderkey") == F.col("_id"), "left_semi")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    heads = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        recipients(spark, sf_dir, ids), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return (
        docs.join(heads, F.col("doc_id") == F.col("o_orderkey"))
        .select(
            F.col("doc_id").alias("id"), F.col("lang").alias("account_key"), F.col("source").alias("source_name"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"),
                     F.lit(".example.com")).alias("sender"),
            F.coalesce("recipients", F.array().cast("array<string>")).alias("recipients"),
            F.substring_index("text", "\n", 1).alias("subject"), F.col("text").alias("body_text"),
            F.when(F.col("doc_id") % 17 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("date_utc"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("thread_key"),
            F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit("@example")).alias("message_id"),
        )
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as threads of messages without dates, in order of turn."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.lit("conv").alias("account_key"),
        F.col("role").alias("sender"), F.array(F.concat(F.col("role"), F.lit("@example.org"))).alias("recipients"),
        F.substring_index("text", "\n", 1).alias("subject"), F.col("text").alias("body_text"), none.alias("date_utc"),
        F.col("conv_id").cast("string").alias("thread_key"), none.alias("message_id"))


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as earlier classifications; every fifth labelled message has an inherited row besides."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("account_key"))
    base = labels.join(docs, "doc_id")
    toxic, quality = F.col("toxic") == 1, F.col("quality")
    own = base.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("message_db_id"), "account_key",
        F.lit("message").alias("target_type"), F.concat(F.lit("labels/q"), quality.cast("string")).alias("category_path"),
        F.when(toxic, "exclude").when(quality == 0, "metadata-only").otherwise("scrubbed").alias("export_profile"),
        F.when(toxic, "high").otherwise("medium").alias("sensitivity"),
        F.when(quality == 1, "rule").otherwise("rule_hint").alias("classifier_type"),
        F.when(quality == 1, 1.0).otherwise(0.75).alias("confidence"))
    more = base.filter(F.col("doc_id") % 5 == 0).select(
        (F.col("doc_id") + 1_000_000).alias("id"), F.col("doc_id").alias("message_db_id"), "account_key",
        F.lit("message").alias("target_type"), F.lit("threads/inherited").alias("category_path"),
        F.lit(None).cast("string").alias("export_profile"), F.lit("medium").alias("sensitivity"),
        F.lit("rule_inherited").alias("classifier_type"), F.lit(1.0).alias("confidence"))
    return own.unionByName(more)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account a language."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("account_key")).distinct().select(
        "account_key", F.concat(F.lit("Mail in "), "account_key").alias("display_name"),
        F.concat("account_key", F.lit("@example.org")).alias("email_address"))


#: The same relations in SQL, as the head of a WITH list.
SQL_MESSAGES = """
recip AS (
  SELECT l_orderkey, list_sort(list_distinct(list('supplier.' || l_suppkey || '@n' || s_nationkey || '.example.net'))) AS recipients
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey),
messages AS (
  SELECT d.doc_id AS id, d.lang AS account_key, d.source AS source_name,
         lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example.com' AS sender,
         coalesce(r.recipients, CAST([] AS VARCHAR[])) AS recipients,
         split_part(d.text, chr(10), 1) AS subject, d.text AS body_text,
         CASE WHEN d.doc_id % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS date_utc,
         'c' || o_custkey AS thread_key, 'm' || d.doc_id || '@example' AS message_id
  FROM documents d JOIN orders ON o_orderkey = d.doc_id JOIN customer ON c_custkey = o_custkey
  LEFT JOIN recip r ON r.l_orderkey = d.doc_id)"""

SQL_CLASSIFICATIONS = """
base AS (SELECT l.*, d.lang AS account_key FROM labels l JOIN documents d USING (doc_id)),
classifications AS (
  SELECT doc_id AS id, doc_id AS message_db_id, account_key, 'labels/q' || quality AS category_path,
         CASE WHEN toxic = 1 THEN 'exclude' WHEN quality = 0 THEN 'metadata-only' ELSE 'scrubbed' END AS export_profile,
         CASE WHEN toxic = 1 THEN 'high' ELSE 'medium' END AS sensitivity,
         CASE WHEN quality = 1 THEN 'rule' ELSE 'rule_hint' END AS classifier_type,
         CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS confidence
  FROM base
  UNION ALL
  SELECT doc_id + 1000000, doc_id, account_key, 'threads/inherited', NULL, 'medium', 'rule_inherited', 1.0::DOUBLE
  FROM base WHERE doc_id % 5 = 0)"""

SQL_CONVERSATIONS = """
conv AS (
  SELECT conv_id * 100 + turn AS id, 'conv' AS account_key, role AS sender, [role || '@example.org'] AS recipients,
         split_part(text, chr(10), 1) AS subject, text AS body_text, CAST(NULL AS VARCHAR) AS date_utc,
         CAST(conv_id AS VARCHAR) AS thread_key
  FROM conversations)"""


def sql_rule(sender: str = "sender", recipients: str = "recipients", subject: str = "subject") -> str:
    """Name of the first matching rule of RULES, null when none does."""
    addresses = f"list_concat([lower(coalesce({sender}, ''))], list_transform({recipients}, lambda a: lower(a)))"
    title = f"lower(coalesce({subject}, ''))"
    return f"""CASE
      WHEN len(list_filter({addresses}, lambda a: suffix(a, '@building.example.com'))) > 0 THEN 'building'
      WHEN len(list_filter({addresses}, lambda a: contains(a, 'customer.00000001'))) > 0 THEN 'early'
      WHEN contains({title}, ' und ') THEN 'german'
      WHEN contains({title}, 'tion') THEN 'tion' END"""


SQL_OUTCOMES = """
outcomes(rule, classifier_type, confidence, category_path, sensitivity, notebooklm_priority, export_profile) AS (VALUES
  ('building', 'rule', 1.0::DOUBLE, 'clients/building-and-co', 'medium', 'high', 'metadata-only'),
  ('early', 'rule_hint', 0.75::DOUBLE, 'clients/early', NULL, NULL, 'scrubbed'),
  ('german', 'rule_hint', 0.75::DOUBLE, 'lang/german', 'low', NULL, 'exclude'),
  ('tion', 'rule', 1.0::DOUBLE, 'topics/tion', 'low', 'low', 'scrubbed'))"""
