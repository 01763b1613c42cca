"""The engine's concepts bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Sets:
    """Orders as the population; of each order's parts the returned ones are true, those with a discount of 5 % are predicted."""

    def __init__(self, spark, d):
        self.lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("target"), "l_returnflag", F.col("l_discount").alias("score"))
        self.population = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_orderpriority").alias("segment"))
        self.truth = self.lines.filter("l_returnflag = 'R'")
        self.predicted = scoring.at_least(self.lines, "score", 0.05)


SETS_SQL = """
lines AS (SELECT l_orderkey AS entity, l_partkey AS target, l_returnflag, l_discount AS score FROM lineitem),
population AS (SELECT o_orderkey AS entity, o_orderpriority AS segment FROM orders),
truth AS (SELECT DISTINCT entity, target FROM lines WHERE l_returnflag = 'R'),
predicted AS (SELECT DISTINCT entity, target FROM lines WHERE score >= 0.05),
hits AS (SELECT entity, COUNT(*) AS tp FROM truth JOIN predicted USING (entity, target) GROUP BY entity),
t_n AS (SELECT entity, COUNT(*) AS n FROM truth GROUP BY entity),
p_n AS (SELECT entity, COUNT(*) AS n FROM predicted GROUP BY entity),
counts AS (SELECT o.entity, o.segment, COALESCE(h.tp, 0) AS tp, COALESCE(p.n, 0) - COALESCE(h.tp, 0) AS fp, COALESCE(t.n, 0) - COALESCE(h.tp, 0) AS fn
  FROM population o LEFT JOIN hits h USING (entity) LEFT JOIN t_n t USING (entity) LEFT JOIN p_n p USING (entity)),
scored AS (SELECT *, CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END ELSE 5.0 * tp / (5 * tp + 4 * fp + fn) END AS f05 FROM counts)"""


class Candidates:
    """Orders as pool records, suppliers as entities: distinct pairs with their highest discount as score, ranked; the owner of an order is the supplier of its first returned line."""

    def __init__(self, spark, d):
        lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pool"), F.col("l_suppkey").alias("entity"), F.col("l_discount").alias("score"), F.col("l_returnflag").alias("route"), F.col("l_linestatus").alias("status"))
        self.routed = scoring.ranked(lines.groupBy("pool", "entity", "route").agg(F.max("score").alias("score")), ["pool", "route"], "score", "entity", start=1)
        self.pairs = scoring.ranked(lines.groupBy("pool", "entity").agg(F.max("score").alias("score")), "pool", "score", "entity")
        self.truth = lines.filter("route = 'R' and status = 'O'").groupBy("pool").agg(F.min("entity").alias("entity"))


CANDIDATES_SQL = """
lines AS (SELECT l_orderkey AS pool, l_suppkey AS entity, l_discount AS score, l_returnflag AS route, l_linestatus AS status FROM lineitem),
routed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pool, route ORDER BY score DESC, entity) AS rank FROM (SELECT pool, entity, route, MAX(score) AS score FROM lines GROUP BY ALL)),
pairs AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pool ORDER BY score DESC, entity) - 1 AS rank FROM (SELECT pool, entity, MAX(score) AS score FROM lines GROUP BY ALL)),
truth AS (SELECT pool, MIN(entity) AS entity FROM lines WHERE route = 'R' AND status = 'O' GROUP BY pool)"""


#: The sources of documents that make up the reference side; all others are pool sources.
REFERENCE_SOURCES = tuple(f"src{k}" for k in range(7))


def texts(spark, d) -> DataFrame:
    """Documents as records: the name is the whole text, the address its source; reference sources are source 1, all others source 2."""
    name = F.lower(F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("source").isin(*REFERENCE_SOURCES), 1).otherwise(2).alias("src"), F.col("lang").alias("country"), name.alias("name"), F.col("source").alias("addr"))


_TOKENS_SQL = """
tokens AS (SELECT DISTINCT id, src, country, term FROM (SELECT id, src, country, unnest(string_split(name, ' ')) AS term FROM records) WHERE term <> '')"""

TEXTS_SQL = f"""
records AS (SELECT doc_id AS id, CASE WHEN source IN {REFERENCE_SOURCES} THEN 1 ELSE 2 END AS src, lang AS country, lower(replace(text, chr(10), ' ')) AS name, source AS addr FROM documents),{_TOKENS_SQL}"""


def records(spark, d) -> DataFrame:
    """Pages as short records: the host is the name, the rest of the address the address, its language the country; plain pages are source 1, mobile ones 3, the others 2."""
    url = F.lower("url")
    src = F.when(url.startswith("http://"), 1).when(url.contains("://m."), 3).otherwise(2)
    name = F.translate(F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1), ".", " ")
    addr = F.trim(F.regexp_replace(F.regexp_extract(url, "^[a-z]+://[^/?#]*(.*)$", 1), "[^a-z0-9]+", " "))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), src.alias("src"), F.regexp_extract(url, "^[a-z]+://[^/]*/([a-z]+)/", 1).alias("country"), name.alias("name"), addr.alias("addr"))


RECORDS_SQL = f"""
records AS (SELECT page_id AS id, CASE WHEN url LIKE 'http://%' THEN 1 WHEN url LIKE '%://m.%' THEN 3 ELSE 2 END AS src, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS country, replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', ' ') AS name,
  trim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '[^a-z0-9]+', ' ', 'g')) AS addr FROM (SELECT page_id, lower(url) AS url FROM pages)),{_TOKENS_SQL}"""
