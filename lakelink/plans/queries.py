"""Queries by name over the driver's tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import similarity as S
from ..functions import text as T
from ..operators import audit, blocking, blocks, features, learning, prediction, scoring, splits
from ..sources import sinks
from .bindings import CANDIDATES_SQL, RECORDS_SQL, SETS_SQL, TEXTS_SQL, Candidates, Sets, records, table, texts

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats rounded, integers as long: what a comparison across engines needs."""
    kinds = {"double": lambda c: F.round(c, digits), "float": lambda c: F.round(c.cast("double"), digits), "int": lambda c: c.cast("long"), "tinyint": lambda c: c.cast("long")}
    return df.select(*(kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))


_MACRO = """COUNT(*) AS entities, ROUND(AVG(f05), 6) AS macro_f05, ROUND(COUNT(*) FILTER (tp + fn = 0) / COUNT(*), 6) AS singleton_fraction,
COUNT(*) FILTER (tp + fn = 0 AND tp + fp > 0) AS false_singleton_count,
ROUND(COUNT(*) FILTER (tp + fn = 0 AND tp + fp > 0) / NULLIF(COUNT(*) FILTER (tp + fn = 0), 0), 6) AS false_singleton_rate,
ROUND(COUNT(*) FILTER (tp + fn > 0 AND tp + fp = 0) / NULLIF(COUNT(*) FILTER (tp + fn > 0), 0), 6) AS missed_non_singleton_rate,
COUNT(*) FILTER (tp + fp > 0) AS nonempty_predictions, ROUND(AVG(CASE WHEN fp + fn = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact_set_accuracy,
ROUND(CAST(SUM(tp) AS DOUBLE) / NULLIF(SUM(tp + fp), 0), 6) AS micro_precision, ROUND(CAST(SUM(tp) AS DOUBLE) / NULLIF(SUM(tp + fn), 0), 6) AS micro_recall"""


def _scored(s: Sets) -> DataFrame:
    return scoring.per_entity(s.population, scoring.set_counts(s.truth, s.predicted, "entity", "target"), "entity")


@query(f"WITH {SETS_SQL} SELECT {_MACRO} FROM scored")
def macro_f05_population(spark, d):
    return _round(scoring.macro(_scored(Sets(spark, d))))


@query(f"WITH {SETS_SQL} SELECT segment, CAST(GROUPING(segment) AS BIGINT) AS is_total, {_MACRO} FROM scored GROUP BY GROUPING SETS ((segment), ())")
def macro_f05_by_segment(spark, d):
    return _round(scoring.macro(_scored(Sets(spark, d)), "segment"))


GRID = [round(k / 100, 2) for k in range(12)]
_SWEEP = f"""WITH {SETS_SQL},
grid AS (SELECT unnest({GRID}) AS threshold),
best AS (SELECT entity, target, MAX(score) AS s FROM lines GROUP BY ALL),
said AS (SELECT g.threshold, b.entity, COUNT(*) AS n, COUNT(t.target) AS tp FROM grid g JOIN best b ON b.s >= g.threshold LEFT JOIN truth t ON t.entity = b.entity AND t.target = b.target GROUP BY ALL),
every AS (SELECT g.threshold, o.entity, COALESCE(x.tp, 0) AS tp, COALESCE(x.n, 0) - COALESCE(x.tp, 0) AS fp, COALESCE(t.n, 0) - COALESCE(x.tp, 0) AS fn
  FROM grid g CROSS JOIN population o LEFT JOIN said x ON x.threshold = g.threshold AND x.entity = o.entity LEFT JOIN t_n t ON t.entity = o.entity),
swept AS (SELECT threshold, AVG(CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END ELSE 5.0 * tp / (5 * tp + 4 * fp + fn) END) AS macro_f05 FROM every GROUP BY threshold)"""


def _swept(spark, d):
    s = Sets(spark, d)
    return scoring.sweep(s.population, s.truth, s.lines, "entity", "target", "score", GRID)


@query(f"{_SWEEP} SELECT CAST(threshold AS DOUBLE) AS threshold, ROUND(macro_f05, 6) AS macro_f05 FROM swept")
def threshold_sweep(spark, d):
    return _round(_swept(spark, d))


@query(f"{_SWEEP} SELECT CAST(threshold AS DOUBLE) AS threshold, ROUND(macro_f05, 6) AS macro_f05 FROM swept ORDER BY ROUND(macro_f05, 12) DESC, threshold DESC LIMIT 1")
def best_threshold(spark, d):
    return _round(scoring.best_threshold(_swept(spark, d)))


@query(f"""WITH {SETS_SQL} SELECT 'empty' AS baseline, ROUND(AVG(CASE WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END), 6) AS macro_f05 FROM scored
UNION ALL SELECT 'perfect', 1.0""")
def analytic_baselines(spark, d):
    s = Sets(spark, d)
    rows = {"empty": s.truth.filter("false"), "perfect": s.truth}
    parts = [scoring.macro(scoring.per_entity(s.population, scoring.set_counts(s.truth, p, "entity", "target"), "entity")).select(F.lit(n).alias("baseline"), "macro_f05") for n, p in rows.items()]
    return _round(parts[0].unionByName(parts[1]))


_ASSIGNED = "assigned AS (SELECT pool, entity, score FROM pairs WHERE rank = 0 AND score >= 0.04)"


def _assigned(c: Candidates):
    return scoring.assign(c.pairs, "pool", "entity", "score", "rank", 0.04)


@query(f"WITH {CANDIDATES_SQL}, {_ASSIGNED} SELECT pool, entity, score FROM assigned")
def pool_assignment(spark, d):
    return _assigned(Candidates(spark, d))


@query(f"""WITH {CANDIDATES_SQL}, {_ASSIGNED},
hits AS (SELECT entity, COUNT(*) AS tp FROM truth JOIN assigned USING (pool, entity) GROUP BY entity),
a AS (SELECT entity, COUNT(*) AS n FROM assigned GROUP BY entity), t AS (SELECT entity, COUNT(*) AS n FROM truth GROUP BY entity),
counts AS (SELECT s_suppkey AS entity, COALESCE(tp, 0) AS tp, COALESCE(a.n, 0) - COALESCE(tp, 0) AS fp, COALESCE(t.n, 0) - COALESCE(tp, 0) AS fn FROM supplier s LEFT JOIN hits ON hits.entity = s_suppkey LEFT JOIN a ON a.entity = s_suppkey LEFT JOIN t ON t.entity = s_suppkey),
scored AS (SELECT *, CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END ELSE 5.0 * tp / (5 * tp + 4 * fp + fn) END AS f05 FROM counts) SELECT {_MACRO} FROM scored""")
def assignment_scores(spark, d):
    c = Candidates(spark, d)
    population = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return _round(scoring.macro(scoring.per_entity(population, scoring.set_counts(c.truth, _assigned(c), "entity", "pool"), "entity")))


@query(f"""WITH {CANDIDATES_SQL}, r AS (SELECT t.pool, MIN(p.rank) AS r FROM truth t LEFT JOIN pairs p USING (pool, entity) GROUP BY t.pool)
SELECT CAST(k AS BIGINT) AS k, COUNT(*) FILTER (r < k) AS hits, ROUND(COUNT(*) FILTER (r < k) / COUNT(*), 6) AS recall FROM r, (SELECT unnest([1, 2, 3, 5, 10]) AS k) GROUP BY k""")
def recall_at_k(spark, d):
    c = Candidates(spark, d)
    return _round(scoring.recall_at(c.pairs, c.truth, "pool", "entity", "rank"))


_REPORT = f"""WITH {SETS_SQL},
report AS (SELECT *, tp + fn AS n, tp + fp AS c, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fn = 0 THEN 1.0 ELSE 5.0 * tp / (5 * tp + fn) END AS oracle FROM counts)"""


@query(f"""{_REPORT} SELECT segment, CAST(GROUPING(segment) AS BIGINT) AS is_total, COUNT(*) AS entities, ROUND(AVG(recall), 6) AS macro_recall, ROUND(CAST(SUM(tp) AS DOUBLE) / NULLIF(SUM(n), 0), 6) AS micro_recall,
ROUND(AVG(oracle), 6) AS oracle_f05, ROUND(AVG(c), 6) AS mean_candidates, COUNT(*) FILTER (n > 0 AND tp = n) AS fully_recalled, COUNT(*) FILTER (n > 0 AND tp = 0) AS zero_recalled,
ROUND(1 - CAST(SUM(c) AS DOUBLE) / (COUNT(*) * (SELECT COUNT(*) FROM part)), 6) AS reduction_ratio FROM report GROUP BY GROUPING SETS ((segment), ())""")
def retrieval_report(spark, d):
    s = Sets(spark, d)
    return _round(scoring.retrieval_report(s.population, s.truth, s.predicted, "entity", "target", "segment", table(spark, d, "part").count()))


@query(f"""WITH {CANDIDATES_SQL}, sizes AS (SELECT pool, COUNT(*) AS n FROM truth GROUP BY pool), hits AS (SELECT r.pool, r.route, COUNT(*) AS h FROM (SELECT DISTINCT pool, entity, route FROM routed) r JOIN truth USING (pool, entity) GROUP BY ALL)
SELECT route, ROUND(SUM(h / n) / (SELECT COUNT(*) FROM sizes), 6) AS macro_recall FROM hits JOIN sizes USING (pool) GROUP BY route""")
def route_recall(spark, d):
    c = Candidates(spark, d)
    return _round(scoring.route_recall(c.truth, c.routed, "pool", "entity", "route"))


@query(f"""WITH {CANDIDATES_SQL}, best AS (SELECT pool, entity, MIN(rank) AS r FROM routed GROUP BY ALL)
SELECT CAST(budget AS BIGINT) AS budget, COUNT(*) AS candidates, COUNT(t.pool) AS hits, ROUND(COUNT(t.pool) / (SELECT COUNT(*) FROM truth), 6) AS micro_recall
FROM (SELECT unnest([1, 2, 3]) AS budget) JOIN best ON r <= budget LEFT JOIN truth t ON t.pool = best.pool AND t.entity = best.entity GROUP BY budget""")
def budget_diagnostics(spark, d):
    c = Candidates(spark, d)
    return _round(scoring.budget_diagnostics(c.truth, c.routed, "pool", "entity", "rank", (1, 2, 3)))


@query(f"WITH {SETS_SQL} SELECT entity, target FROM truth EXCEPT SELECT entity, target FROM predicted")
def missed_pairs(spark, d):
    s = Sets(spark, d)
    return scoring.missed_pairs(s.truth, s.predicted, "entity", "target")


@query(f"""WITH {CANDIDATES_SQL}, {_ASSIGNED} SELECT kind, COUNT(*) AS n FROM (SELECT CASE WHEN t.pool IS NULL THEN 'false_distractor' WHEN t.entity = a.entity THEN 'correct' WHEN a.entity IS NOT NULL THEN 'wrong_entity'
WHEN p.pool IS NULL THEN 'missing_candidate' ELSE 'below_threshold' END AS kind FROM truth t FULL JOIN assigned a ON a.pool = t.pool LEFT JOIN pairs p ON p.pool = t.pool AND p.entity = t.entity) GROUP BY kind""")
def error_breakdown(spark, d):
    c = Candidates(spark, d)
    return scoring.error_kinds(c.pairs, _assigned(c), c.truth, "pool", "entity")


@query(f"""WITH {SETS_SQL}, t AS (SELECT entity, CASE WHEN target % 2 = 0 THEN 'even' ELSE 'odd' END AS source, COUNT(*) AS n, COUNT(p.target) AS h FROM truth LEFT JOIN predicted p USING (entity, target) GROUP BY ALL)
SELECT source, COUNT(*) AS entities, ROUND(AVG(h / n), 6) AS macro_recall FROM t GROUP BY source""")
def source_recall(spark, d):
    s = Sets(spark, d)
    return _round(scoring.source_recall(s.truth, s.predicted, "entity", "target", F.when(F.col("target") % 2 == 0, "even").otherwise("odd")))


@query(f"WITH {SETS_SQL} SELECT entity, tp + fn AS n_true, tp AS n_found, tp + fp AS n_candidates, ROUND(tp / NULLIF(tp + fn, 0), 6) AS recall FROM counts")
def entity_recall(spark, d):
    s = Sets(spark, d)
    return _round(scoring.entity_recall(s.population, s.truth, s.predicted, "entity", "target"))


@query(f"WITH {SETS_SQL}, r AS (SELECT tp / (tp + fn) AS x FROM counts WHERE tp + fn > 0) SELECT COUNT(x) AS n, MIN(x) AS least, MAX(x) AS greatest, ROUND(AVG(x), 6) AS mean, " + ", ".join(f"ROUND(quantile_cont(x, {q}), 6) AS p{round(q * 100):02d}" for q in audit.QUANTILES) + " FROM r")
def recall_distribution(spark, d):
    s = Sets(spark, d)
    return _round(audit.distribution(scoring.entity_recall(s.population, s.truth, s.predicted, "entity", "target"), F.col("recall")))


@query(f"{_REPORT} SELECT segment, CAST(GROUPING(segment) AS BIGINT) AS is_total, ROUND(AVG(recall), 6) AS macro_recall FROM report GROUP BY GROUPING SETS ((segment), ())")
def checked_recall(spark, d):
    """The report's macro recall, held against the mean of the recalls of single entities."""
    s = Sets(spark, d)
    report = scoring.retrieval_report(s.population, s.truth, s.predicted, "entity", "target", "segment", 1).select("segment", "is_total", "macro_recall")
    single = scoring.entity_recall(s.population, s.truth, s.predicted, "entity", "target").join(s.population, "entity").groupingSets([[F.col("segment")], []], F.col("segment")).agg(F.grouping("segment").cast("long").alias("is_total"), F.avg("recall").alias("macro_recall"))
    return _round(scoring.checked_report(report, single, ["segment", "is_total"], ["macro_recall"]))


@query(f"WITH {CANDIDATES_SQL}, {_ASSIGNED} SELECT COUNT(DISTINCT entity) AS entities FROM assigned")
def used_entities(spark, d):
    return scoring.used_entities(_assigned(Candidates(spark, d)), "entity")


_BY_SCORE = "best AS (SELECT entity, CAST(target AS VARCHAR) AS t, MAX(score) AS s FROM lines GROUP BY ALL)"


@query(f"""WITH {SETS_SQL}, {_BY_SCORE}
SELECT o.entity, COALESCE(string_agg(t, ',' ORDER BY t) FILTER (s >= 0.05), '') AS matched_ids, COALESCE(string_agg(t, ',' ORDER BY t), '') AS candidate_ids FROM population o LEFT JOIN best USING (entity) GROUP BY o.entity""")
def prediction_lists(spark, d):
    """Matches by the candidates' own scores, without a model."""
    s = Sets(spark, d)
    return prediction.lists(s.population, s.lines, "entity", "target", "score", 0.05)


@query(f"""WITH {CANDIDATES_SQL} SELECT COUNT(*) AS pairs, COUNT(*) FILTER (s_suppkey IS NULL) AS missing_entity, COUNT(*) FILTER (s_suppkey IS NOT NULL AND o_orderkey IS NULL) AS missing_candidate, COUNT(*) FILTER (s_suppkey IS NOT NULL AND o_orderkey IS NOT NULL) AS kept
FROM pairs LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = entity LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = pool""")
def candidate_misses(spark, d):
    """Candidates whose records are not there: suppliers in debt and pending orders have none."""
    a = table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", F.struct("s_name").alias("r"))
    b = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", F.struct("o_orderstatus").alias("r"))
    return features.missing_records(features.with_records(Candidates(spark, d).pairs, a, b, "entity", "pool"))


@query(f"""WITH {CANDIDATES_SQL} SELECT pool, BOOL_OR(entity % 10 = 0 AND rank < 3) AS held FROM pairs GROUP BY pool""")
def evaluation_pools(spark, d):
    held = table(spark, d, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("entity"))
    return splits.evaluation_pools(Candidates(spark, d).pairs, held, "pool", "entity", "rank")


# Audits


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def dup_ids(spark, d):
    return _round(audit.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphans_left(spark, d):
    return audit.orphans(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans_right(spark, d):
    return audit.orphans(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "doc_id")


@query("SELECT l_partkey AS target, COUNT(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT l_suppkey) > 1")
def multi_owner_targets(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("target"))
    return audit.owners_of(edges, "owner", "target")


@query("""SELECT a.n_regionkey AS customer_region, b.n_regionkey AS supplier_region, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2""")
def cross_segment_pairs(spark, d):
    t = lambda n: table(spark, d, n)
    nation = lambda k, r: t("nation").select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(r))
    customers = t("customer").join(nation("c_nationkey", "customer_region"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "customer_region")
    suppliers = t("supplier").join(nation("s_nationkey", "supplier_region"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "supplier_region")
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customers, "o_custkey")
    joined = t("lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").join(suppliers, "l_suppkey").filter("customer_region <> supplier_region")
    return joined.groupBy("customer_region", "supplier_region").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT s_suppkey FROM supplier")
def id_overlap(spark, d):
    return audit.shared_ids(table(spark, d, "customer"), table(spark, d, "supplier"), "c_custkey", "s_suppkey")


@query("""SELECT COUNT(x) AS n, MIN(x) AS least, MAX(x) AS greatest, ROUND(AVG(x), 6) AS mean, """ + ", ".join(f"ROUND(quantile_cont(x, {q}), 6) AS p{round(q * 100):02d}" for q in audit.QUANTILES) + " FROM (SELECT CAST(length(text) AS BIGINT) AS x FROM documents)")
def length_distribution(spark, d):
    return _round(audit.distribution(table(spark, d, "documents"), F.length("text").cast("long")))


_CELLS = ", ".join(
    f"COUNT(*) FILTER (regexp_matches({c}, '^\\s*$')) AS {c}_blank, COUNT(*) FILTER (lower(trim({c})) IN ('null', 'none', 'nan', 'na', 'n/a', '<na>')) AS {c}_null_like, COUNT(*) FILTER (regexp_matches({c}, '^\\s|\\s$')) AS {c}_padded, COUNT(*) FILTER ({c} IS NULL) AS {c}_null"
    for c in ("lang", "source")
)


@query(f"SELECT lang, COUNT(*) AS rows, {_CELLS} FROM documents GROUP BY lang")
def blank_null_like_audit(spark, d):
    return audit.cell_audit(table(spark, d, "documents").select("lang", "source"), ["lang", "source"], "lang")


@query("""SELECT country, CAST(GROUPING(country) AS BIGINT) AS is_total, COUNT(*) AS rows, CAST(SUM(CAST(regexp_matches(addr, '[0-9]') AS INT)) AS BIGINT) AS has_number, CAST(SUM(CAST(addr = '' AS INT)) AS BIGINT) AS address_missing FROM records GROUP BY ROLLUP (country)""".join([f"WITH {RECORDS_SQL} ", ""]))
def flag_counts_by_country(spark, d):
    return audit.flag_counts(records(spark, d), {"has_number": F.col("addr").rlike("[0-9]"), "address_missing": F.col("addr") == ""}, "country")


_TRUTH = """truth AS (SELECT o_orderkey AS id, COALESCE(ids, '') AS matched_entity_ids FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT CASE WHEN l_returnflag = 'R' THEN 'S2-' ELSE 'S3-' END || l_partkey, ',') AS ids FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) x ON l_orderkey = o_orderkey)"""


def _truth_lists(spark, d):
    lines = table(spark, d, "lineitem").filter("l_returnflag <> 'N'")
    pairs = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.when(F.col("l_returnflag") == "R", "S2-").otherwise("S3-"), "l_partkey").alias("target"))
    return sinks.id_lists(table(spark, d, "orders"), pairs, "o_orderkey", "target", "matched_entity_ids")


@query(f"""WITH {_TRUTH}, parts AS (SELECT *, CASE WHEN matched_entity_ids = '' THEN [] ELSE string_split(matched_entity_ids, ',') END AS p FROM truth)
SELECT CASE WHEN contains(matched_entity_ids, 'S2-') AND contains(matched_entity_ids, 'S3-') THEN 'both' WHEN contains(matched_entity_ids, 'S2-') THEN 'S2_only' WHEN contains(matched_entity_ids, 'S3-') THEN 'S3_only' ELSE 'singleton' END AS kind,
COUNT(*) AS entities, CAST(SUM(len(p)) AS BIGINT) AS edges, COUNT(*) FILTER (len(list_distinct(p)) <> len(p)) AS duplicate_lists, CAST(0 AS BIGINT) AS bad_tokens FROM parts GROUP BY 1""")
def truth_kinds(spark, d):
    return audit.truth_audit(_truth_lists(spark, d))


@query(f"WITH {_TRUTH} SELECT CASE WHEN matched_entity_ids = '' THEN 0 ELSE CAST(len(string_split(matched_entity_ids, ',')) AS BIGINT) END AS match_count, COUNT(*) AS entities FROM truth GROUP BY 1")
def match_count_hist(spark, d):
    return _truth_lists(spark, d).groupBy(F.size(I.id_list(F.col("matched_entity_ids"))).cast("long").alias("match_count")).agg(F.count("*").alias("entities"))


@query("""SELECT event_type, event_id, place FROM (SELECT event_type, event_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events) WHERE place <= 3""")
def first_examples(spark, d):
    return _round(audit.first_examples(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id"))


# Splits


_SPLIT = """hashed AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS stratum, sha256('[20260925,"' || c_custkey || '"]') AS split_hash FROM customer),
sized AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment, stratum ORDER BY split_hash, id) AS place, COUNT(*) OVER (PARTITION BY segment, stratum) AS n FROM hashed),
split AS (SELECT id, segment, split_hash, CASE WHEN n > 1 AND place <= LEAST(n - 1, GREATEST(1, FLOOR(n * 0.2 + 0.5))) THEN 'validation' ELSE 'train' END AS role FROM sized)"""


def _split(spark, d):
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("stratum"))
    return splits.stratified(who, "id", ["segment", "stratum"]).drop("stratum")


@query(f"WITH {_SPLIT} SELECT * FROM split")
def stratified_split(spark, d):
    return _split(spark, d)


@query("""SELECT c_custkey AS id, ROW_NUMBER() OVER (ORDER BY sha256('[0,"' || c_custkey || '"]'), c_custkey) - 1 AS code FROM customer""")
def group_codes(spark, d):
    return splits.group_codes(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id")


@query("""WITH s AS (SELECT DISTINCT c_mktsegment AS x FROM customer) SELECT 'grouped' AS mode, NULL AS train_segment, NULL AS test_segment UNION ALL
SELECT 'transfer_' || lpad(CAST(ROW_NUMBER() OVER (ORDER BY a.x, b.x) AS VARCHAR), 2, '0'), a.x, b.x FROM s a, s b WHERE a.x <> b.x""")
def transfer_modes(spark, d):
    return splits.modes(table(spark, d, "customer"), "c_mktsegment")


@query(f"""WITH {_SPLIT} SELECT id, role AS grouped, CASE segment WHEN 'AUTOMOBILE' THEN 'train' WHEN 'BUILDING' THEN 'validation' ELSE 'excluded' END AS transfer_01 FROM split""")
def fold_roles(spark, d):
    modes = {"grouped": ("grouped", None, None), "transfer_01": ("transfer_01", "AUTOMOBILE", "BUILDING")}
    return _split(spark, d).select("id", *(splits.role(m, F.col("segment"), F.col("role")).alias(n) for n, m in modes.items()))


@query(f"WITH {_SPLIT} SELECT id FROM split WHERE role = 'validation' ORDER BY split_hash, id LIMIT 100")
def pilot_population(spark, d):
    return _split(spark, d).filter("role = 'validation'").orderBy("split_hash", "id").limit(100).select("id")


# Sinks


@query(f"WITH {SETS_SQL} SELECT o.entity, COALESCE(string_agg(CAST(p.target AS VARCHAR), ',' ORDER BY CAST(p.target AS VARCHAR)), '') AS matched_ids FROM population o LEFT JOIN predicted p USING (entity) GROUP BY o.entity")
def write_match_lists(spark, d):
    s = Sets(spark, d)
    return sinks.id_lists(s.population, s.predicted, "entity", "target")


@query("""WITH first AS (SELECT l_suppkey AS entity, l_orderkey AS target, MIN(l_linenumber) AS o FROM lineitem GROUP BY ALL)
SELECT s_suppkey AS entity, COALESCE(string_agg(CAST(target AS VARCHAR), ',' ORDER BY o, CAST(target AS VARCHAR)), '') AS candidate_ids FROM supplier LEFT JOIN first ON entity = s_suppkey GROUP BY s_suppkey""")
def candidate_lists(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("target"), "l_linenumber")
    return sinks.id_lists(table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity")), pairs, "entity", "target", "candidate_ids", F.col("l_linenumber"))


@query(f"WITH {SETS_SQL} SELECT entity, target FROM predicted EXCEPT SELECT entity, target FROM truth")
def subset_violations(spark, d):
    s = Sets(spark, d)
    return sinks.outside(s.predicted, s.truth, ["entity", "target"])


@query("""SELECT o_orderkey AS key, COALESCE(l_returnflag, o_orderstatus) AS state FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_returnflag)) AS l_returnflag FROM lineitem WHERE l_discount >= 0.08 GROUP BY 1) ON l_orderkey = o_orderkey""")
def upserted(spark, d):
    """The state of each order, replaced by that of its last line with a large discount."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state"), F.lit(None).cast("struct<d:timestamp_ntz,l:int,p:bigint,f:string>").alias("at"))
    at = F.struct(F.col("l_shipdate").cast("timestamp_ntz").alias("d"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"))
    changes = table(spark, d, "lineitem").filter("l_discount >= 0.08").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("state"), at.alias("at"))
    return sinks.upsert(base, changes, ["key"], "at").select("key", "state")


# Terms and blocking


@query("""WITH w AS (SELECT p_partkey AS id, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS w FROM part)
SELECT term, COUNT(*) AS n FROM (SELECT unnest(list_concat(list_transform(w, lambda x: 'n:' || x), list_transform(range(1, len(w)), lambda i: 'm:' || w[i] || '_' || w[i + 1]))) AS term FROM w) GROUP BY term""")
def bigram_terms(spark, d):
    tokens = F.transform(F.filter(F.split("p_name", " "), lambda w: w != ""), lambda w: F.concat(F.lit("n:"), w))
    return table(spark, d, "part").select(F.explode(T.name_bigrams(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {TEXTS_SQL} SELECT term, COUNT(*) AS df FROM tokens GROUP BY term")
def token_df(spark, d):
    return blocking.document_frequency(blocking.postings(texts(spark, d), ["id"], T.words(F.col("name"))))


@query(f"WITH {TEXTS_SQL} SELECT term, COUNT(*) AS df, ROUND(ln(((SELECT COUNT(*) FROM records WHERE src = 1) + 1) / (COUNT(*) + 1)) + 1, 6) AS idf FROM tokens WHERE src = 1 GROUP BY term")
def idf_table(spark, d):
    train = texts(spark, d).filter("src = 1")
    return _round(blocking.idf_table(blocking.postings(train, ["id"], T.words(F.col("name"))), train))


@query(f"WITH {TEXTS_SQL} SELECT term, COUNT(*) AS df FROM tokens WHERE length(term) >= 3 GROUP BY term HAVING COUNT(*) BETWEEN 2 AND GREATEST(2, FLOOR((SELECT COUNT(*) FROM records) * 0.01))")
def rare_vocab(spark, d):
    every = texts(spark, d)
    return blocking.rare_terms(blocking.postings(every, ["id"], T.words(F.col("name"))), every, 0.01)


_TFIDF = f"""WITH {TEXTS_SQL}, n AS (SELECT country, COUNT(DISTINCT id) AS n FROM tokens GROUP BY country), df AS (SELECT country, term, COUNT(*) AS df FROM tokens GROUP BY ALL HAVING COUNT(*) <= 3000),
w AS (SELECT t.id, t.src, t.country, t.term, ln((n + 1) / (df + 1)) + 1 AS w FROM tokens t JOIN df USING (country, term) JOIN n USING (country)),
v AS (SELECT id, src, country, term, w / sqrt(SUM(w * w) OVER (PARTITION BY id)) AS w FROM w),
sim AS (SELECT q.id AS pool, t.id AS entity, ROUND(SUM(q.w * t.w), 9) AS score FROM v q JOIN v t ON q.country = t.country AND q.term = t.term AND q.src <> 1 AND t.src = 1 GROUP BY ALL),
top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pool ORDER BY score DESC, entity) - 1 AS rank FROM sim WHERE score > 0.01)"""


def _top(every, max_df=3000, n_all=None):
    """Each pool record's ten most similar reference records of its country, by terms of at most ``max_df`` of the country's records."""
    got = blocks.similar_top_k(every, "country", F.col("src") != 1, "id", T.words(F.col("name")), max_df, 10, n_all=n_all)
    return got.withColumnsRenamed({"query": "pool", "target": "entity"}).select("pool", "entity", "score", "rank", *(["beside"] if n_all is not None else []))


@query(f"{_TFIDF} SELECT pool, entity, FLOOR(score * 1000000 + 0.5) / 1000000 AS score, rank FROM top WHERE rank < 10")
def tfidf_topk(spark, d):
    return _top(texts(spark, d)).withColumn("score", F.floor(F.col("score") * 1000000 + 0.5) / 1000000)  # halves go up in either engine


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings), n AS (SELECT vec_id, sqrt(SUM(CAST(x AS DOUBLE) * x)) AS n FROM v GROUP BY 1), u AS (SELECT vec_id, label, i, x / NULLIF(n, 0) AS x FROM v JOIN n USING (vec_id)),
s AS (SELECT a.vec_id AS query, b.vec_id AS target, ROUND(SUM(a.x * b.x), 9) AS score FROM u a JOIN u b ON a.i = b.i AND a.label = b.label WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT query, target, ROUND(score, 6) AS score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, target) - 1 AS rank FROM s) WHERE rank < 5""")
def embedding_topk(spark, d):
    """Queries (ids divisible by 100) against all rows of their label: the queries are a bounded share, matched block by block on the label."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.select("vec_id", "label", F.transform("v", lambda x: x / F.nullif(norm, F.lit(0.0))).alias("u"))
    q = unit.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label", F.col("u").alias("q"))
    pairs = unit.withColumnRenamed("vec_id", "target").join(q, "label").filter("query <> target")
    dot = F.aggregate(F.zip_with("q", "u", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return _round(scoring.ranked(pairs.select("query", "target", F.round(dot, 9).alias("score")), "query", "score", "target", most=5))


_PAIRS = "part_pairs AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_name < b.p_name)"


def _part_pairs(spark, d):
    one = table(spark, d, "part").select("p_brand", "p_size", "p_name").distinct()
    return one.withColumnRenamed("p_name", "a").join(one.withColumnRenamed("p_name", "b"), ["p_brand", "p_size"]).filter("a < b").select("a", "b").distinct()


@query(f"""WITH {_PAIRS}, g AS (SELECT a, b, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substring(a, i, 3))) AS x, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substring(b, i, 3))) AS y FROM part_pairs)
SELECT a, b, ROUND(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM g""")
def trigram_jaccard_pairs(spark, d):
    return _round(_part_pairs(spark, d).withColumn("jaccard", S.jaccard(F.array_distinct(T.trigrams(F.col("a"), True)), F.array_distinct(T.trigrams(F.col("b"), True)))))


@query(f"""WITH {_PAIRS}, g AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM part_pairs)
SELECT a, b, ROUND(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM g""")
def token_jaccard_pairs(spark, d):
    return _round(_part_pairs(spark, d).withColumn("jaccard", S.jaccard(T.words(F.col("a")), T.words(F.col("b")))))


@query(f"""{_TFIDF}, p AS (SELECT pool, entity FROM top WHERE rank < 10), alldf AS (SELECT term, COUNT(*) AS df FROM tokens GROUP BY term),
q AS (SELECT id, term, pow(ln(((SELECT COUNT(*) FROM records) + 1) / (df + 1)) + 1, 2) AS w FROM tokens JOIN alldf USING (term)), nn AS (SELECT id, sqrt(SUM(w)) AS n FROM q GROUP BY id)
SELECT pool, entity, ROUND(SUM(a.w) / GREATEST(MAX(x.n * y.n), 1e-6), 6) AS n_wcos FROM p JOIN q a ON a.id = pool JOIN q b ON b.id = entity AND a.term = b.term JOIN nn x ON x.id = pool JOIN nn y ON y.id = entity GROUP BY pool, entity""")
def weighted_cosine_pairs(spark, d):
    every = texts(spark, d)
    return _round(_top(every, n_all=every.count()).select("pool", "entity", F.col("beside").alias("n_wcos")))


LIMITS = blocking.Limits()
_GRAMS = f"""WITH {RECORDS_SQL}, grams AS (SELECT DISTINCT id, src, term FROM (SELECT id, src, unnest(list_transform(range(1, length(name) - 1), lambda i: substring(name, i, 3))) AS term FROM records WHERE length(name) >= 3)),
pool AS (SELECT id AS record, term FROM grams WHERE src <> 1), df AS (SELECT term, COUNT(*) AS df FROM pool GROUP BY term),
anchor AS (SELECT query, term, df, place FROM (SELECT id AS query, term, df, ROW_NUMBER() OVER (PARTITION BY id ORDER BY df, term) AS place FROM grams JOIN df USING (term) WHERE src = 1) WHERE place <= 8)"""


def _grams(spark, d):
    every = records(spark, d)
    post = lambda side, k: blocking.postings(every.filter(side).withColumnRenamed("id", k), [k], T.trigrams(F.col("name")))
    q, p = post("src = 1", "query"), post("src <> 1", "record")
    return q, p, blocking.anchors(q, blocking.document_frequency(p), "query", 8)


@query(f"{_GRAMS} SELECT query, term, df, place FROM anchor")
def anchor_terms(spark, d):
    return _round(_grams(spark, d)[2])


_SHORT = f"""{_GRAMS}, capped AS (SELECT term, record FROM (SELECT term, record, ROW_NUMBER() OVER (PARTITION BY term ORDER BY record) AS p FROM pool) WHERE p <= 96),
conj AS (SELECT query, record FROM (SELECT a.query, x.record, ROW_NUMBER() OVER (PARTITION BY a.query, a.place ORDER BY x.record) AS p FROM anchor a JOIN anchor b ON a.query = b.query AND b.place = a.place + 1 AND a.place IN (1, 3, 5) JOIN pool x ON x.term = a.term JOIN pool y ON y.term = b.term AND y.record = x.record) WHERE p <= 96),
hits AS (SELECT query, record, COUNT(*) AS hits FROM (SELECT query, record FROM anchor JOIN capped USING (term) UNION ALL SELECT query, record FROM conj) GROUP BY ALL),
short AS (SELECT query, record, hits FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY hits DESC, record) AS p FROM hits) WHERE p <= 96)"""


@query(f"{_SHORT} SELECT query, record, hits FROM short")
def posting_shortlist(spark, d):
    q, p, a = _grams(spark, d)
    return blocking.shortlist(a, p, "query", "record", LIMITS.postings, LIMITS.shortlist)


_WORDS = f"""WITH {RECORDS_SQL}, pool AS (SELECT id AS record, term FROM tokens WHERE src <> 1), df AS (SELECT term, COUNT(*) AS df FROM pool WHERE length(term) >= 2 GROUP BY term HAVING COUNT(*) <= 100),
rare AS (SELECT DISTINCT query, record FROM (SELECT query, term FROM (SELECT id AS query, term, ROW_NUMBER() OVER (PARTITION BY id ORDER BY df, term) AS p FROM tokens JOIN df USING (term) WHERE src = 1) WHERE p <= 8) JOIN pool USING (term))"""


def _words(spark, d, column="name"):
    every = records(spark, d)
    post = lambda side, k: blocking.postings(every.filter(side).withColumnRenamed("id", k), [k], T.words(F.col(column)))
    return post("src = 1", "query"), post("src <> 1", "record")


@query(f"{_WORDS} SELECT query, record FROM rare")
def rare_route(spark, d):
    return blocking.rare_route(*_words(spark, d), "query", "record", LIMITS.rare_max_df, LIMITS.anchors)


_PARTS = f"""WITH {TEXTS_SQL}, parts AS (SELECT DISTINCT id, src, unnest(regexp_extract_all(name, '[0-9]{{5,}}')) AS term FROM records),
comp AS (SELECT DISTINCT query, record FROM (SELECT a.id AS query, b.id AS record, ROW_NUMBER() OVER (PARTITION BY a.id, a.term ORDER BY b.id) AS p FROM parts a JOIN parts b USING (term) WHERE a.src = 1 AND b.src <> 1) WHERE p <= 96)"""


def _parts(spark, d):
    every = texts(spark, d).select("id", "src", F.explode(F.regexp_extract_all("name", F.lit("([0-9]{5,})"), F.lit(1))).alias("term")).distinct()
    return (every.filter(side).withColumnRenamed("id", k) for side, k in (("src = 1", "query"), ("src <> 1", "record")))


@query(f"{_PARTS} SELECT query, record FROM comp")
def component_route(spark, d):
    return blocking.component_route(*_parts(spark, d), "query", "record", LIMITS.shortlist)


def _five_routes() -> str:
    """All five routes of ``blocking.retrieve`` over the pages, as SQL: ``top`` has query, record, route, score, rank."""
    parts = [f"""WITH {RECORDS_SQL},
numbered AS (SELECT *, list_distinct(list_filter(string_split(addr, ' '), lambda x: regexp_full_match(x, '[0-9]{{1,4}}'))) AS houses, list_distinct(list_filter(string_split(addr, ' '), lambda x: regexp_full_match(x, '[0-9]{{5,}}'))) AS postals FROM records),
house AS (SELECT id, src, unnest(houses) AS term FROM numbered), postal AS (SELECT id, src, unnest(postals) AS term FROM numbered),
train AS (SELECT COUNT(*) AS n FROM records WHERE src = 1)"""]
    for f in blocking.FIELDS:
        parts.append(f"""tf_{f} AS (SELECT id, src, term, COUNT(*) AS tf FROM (SELECT id, src, unnest(list_transform(range(1, length({f}) - 1), lambda i: substring({f}, i, 3))) AS term FROM records WHERE length({f}) >= 3) GROUP BY ALL),
pool_{f} AS (SELECT id AS record, term FROM tf_{f} WHERE src <> 1), df_{f} AS (SELECT term, COUNT(*) AS df FROM pool_{f} GROUP BY term),
anchor_{f} AS (SELECT * FROM (SELECT id AS query, term, ROW_NUMBER() OVER (PARTITION BY id ORDER BY df, term) AS place FROM tf_{f} JOIN df_{f} USING (term) WHERE src = 1) WHERE place <= 8),
capped_{f} AS (SELECT term, record FROM (SELECT term, record, ROW_NUMBER() OVER (PARTITION BY term ORDER BY record) AS p FROM pool_{f}) WHERE p <= 96),
conj_{f} AS (SELECT query, record FROM (SELECT a.query, x.record, ROW_NUMBER() OVER (PARTITION BY a.query, a.place ORDER BY x.record) AS p FROM anchor_{f} a JOIN anchor_{f} b ON a.query = b.query AND b.place = a.place + 1 AND a.place IN (1, 3, 5)
  JOIN pool_{f} x ON x.term = a.term JOIN pool_{f} y ON y.term = b.term AND y.record = x.record) WHERE p <= 96),
short_{f} AS (SELECT query, record FROM (SELECT query, record, ROW_NUMBER() OVER (PARTITION BY query ORDER BY COUNT(*) DESC, record) AS p FROM (SELECT query, record FROM anchor_{f} JOIN capped_{f} USING (term) UNION ALL SELECT * FROM conj_{f}) GROUP BY query, record) WHERE p <= 96),
word_{f} AS (SELECT DISTINCT id, src, term FROM (SELECT id, src, unnest(string_split({f}, ' ')) AS term FROM records) WHERE term <> ''),
wdf_{f} AS (SELECT term, COUNT(*) AS df FROM word_{f} WHERE src <> 1 GROUP BY term),
rare_{f} AS (SELECT DISTINCT query, w.id AS record FROM (SELECT id AS query, term, ROW_NUMBER() OVER (PARTITION BY id ORDER BY df, term) AS p FROM word_{f} JOIN wdf_{f} USING (term) WHERE src = 1 AND length(term) >= 2 AND df <= 100) q JOIN word_{f} w ON w.term = q.term AND w.src <> 1 WHERE p <= 8),
gated_{f} AS (SELECT DISTINCT q.query, w.id AS record FROM (SELECT id AS query, term, ROW_NUMBER() OVER (PARTITION BY id ORDER BY df, term) AS p FROM word_{f} JOIN wdf_{f} USING (term) WHERE src = 1 AND df <= 5000) q JOIN word_{f} w ON w.term = q.term AND w.src <> 1
  JOIN house a ON a.id = q.query JOIN house b ON b.id = w.id AND a.term = b.term WHERE p <= 2)""")
    parts.append("""tf_both AS (SELECT id, src, term, SUM(tf) AS tf FROM (SELECT * FROM tf_name UNION ALL SELECT * FROM tf_addr) GROUP BY ALL),
crossed AS (SELECT query, record FROM (SELECT a.query, x.record, ROW_NUMBER() OVER (PARTITION BY a.query, a.place ORDER BY x.record) AS p FROM anchor_name a JOIN anchor_addr b ON a.query = b.query AND a.place = b.place AND a.place <= 3
  JOIN pool_name x ON x.term = a.term JOIN pool_addr y ON y.term = b.term AND y.record = x.record) WHERE p <= 96),
equal AS (SELECT query, record FROM (SELECT a.id AS query, b.id AS record, ROW_NUMBER() OVER (PARTITION BY a.id, a.term ORDER BY b.id) AS p FROM postal a JOIN postal b USING (term) WHERE a.src = 1 AND b.src <> 1) WHERE p <= 96),
hits AS (SELECT 'name' AS route, 96 AS most, * FROM short_name UNION SELECT 'address', 96, * FROM short_addr UNION SELECT 'combined', 288, * FROM (SELECT * FROM short_name UNION SELECT * FROM short_addr UNION SELECT * FROM crossed)
  UNION SELECT 'rare', 96, * FROM (SELECT * FROM rare_name UNION SELECT * FROM rare_addr) UNION SELECT 'components', 96, * FROM (SELECT * FROM equal UNION SELECT * FROM gated_name UNION SELECT * FROM gated_addr)),
cut AS (SELECT route, query, record, CASE route WHEN 'name' THEN 'name' WHEN 'address' THEN 'addr' ELSE 'both' END AS kind FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY route, query ORDER BY record) AS p FROM hits) WHERE p <= most)""")
    for f in (*blocking.FIELDS, "both"):
        parts.append(f"""idf_{f} AS (SELECT term, ln((n + 1) / (COUNT(*) + 1)) + 1 AS idf FROM tf_{f}, train WHERE src = 1 GROUP BY term, n),
w_{f} AS (SELECT id, term, tf * COALESCE(idf, ln(n + 1) + 1) AS w FROM tf_{f} CROSS JOIN train LEFT JOIN idf_{f} USING (term)), v_{f} AS (SELECT '{f}' AS kind, id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY id)) AS w FROM w_{f})""")
    parts.append("""v AS (SELECT * FROM v_name UNION ALL SELECT * FROM v_addr UNION ALL SELECT * FROM v_both),
dot AS (SELECT kind, query, record, SUM(a.w * b.w) AS d FROM (SELECT DISTINCT kind, query, record FROM cut) c JOIN v a USING (kind) JOIN v b USING (kind) WHERE a.id = query AND b.id = record AND a.term = b.term GROUP BY ALL),
scored AS (SELECT c.*, ROUND(LEAST(1, GREATEST(0, COALESCE(d, 0))), 9) AS score FROM cut c LEFT JOIN dot USING (kind, query, record)),
top AS (SELECT query, record, route, score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query, route ORDER BY score DESC, record) AS rank FROM scored WHERE score > 0 OR route IN ('rare', 'components')) WHERE rank <= 20)""")
    return ",\n".join(parts)


_FIVE = _five_routes()


def _retrieved(spark, d):
    """Candidates of all five routes for the reference pages; numbers of up to four digits in a page's address are its house numbers, longer ones its postcodes."""
    digits = lambda least, most: F.array_distinct(F.filter(F.split("addr", " "), lambda x: x.rlike(f"^[0-9]{{{least},{most}}}$")))
    every = records(spark, d).withColumns({"houses": digits(1, 4), "postals": digits(5, "")})
    reference = every.filter("src = 1")
    return blocking.retrieve(reference, every.filter("src <> 1"), reference)


@query(f"{_FIVE} SELECT query, record, string_agg(route, ',' ORDER BY route) AS routes, ROUND(MAX(score), 6) AS best_score, MIN(rank) AS best_rank FROM top GROUP BY query, record")
def route_union(spark, d):
    best = F.array_min(F.transform(F.map_values("metadata"), lambda v: v["rank"])).alias("best_rank")
    return _round(_retrieved(spark, d).select("query", "record", "routes", "best_score", best))


@query(f"""{_GRAMS}, tf AS (SELECT id, src, term, COUNT(*) AS tf FROM (SELECT id, src, unnest(list_transform(range(1, length(name) - 1), lambda i: substring(name, i, 3))) AS term FROM records WHERE length(name) >= 3) GROUP BY ALL),
n AS (SELECT COUNT(*) AS n FROM records WHERE src = 1), idf AS (SELECT term, ln((n + 1) / (COUNT(*) + 1)) + 1 AS idf FROM grams, n WHERE src = 1 GROUP BY term, n),
w AS (SELECT id, src, term, tf * COALESCE(idf, ln(n + 1) + 1) AS w FROM tf CROSS JOIN n LEFT JOIN idf USING (term)), v AS (SELECT id, src, term, w / sqrt(SUM(w * w) OVER (PARTITION BY id)) AS w FROM w),
cand AS (SELECT DISTINCT query, record FROM anchor JOIN pool USING (term))
SELECT query, record, ROUND(ROUND(LEAST(1, GREATEST(0, SUM(a.w * b.w))), 9), 6) AS score FROM cand JOIN v a ON a.id = query JOIN v b ON b.id = record AND a.term = b.term GROUP BY query, record""")
def gram_cosine_rerank(spark, d):
    """Scores are made once for two lists of grams, however many pages have them, and given to all their pages at the end."""
    grams = records(spark, d).groupBy((F.col("src") == 1).alias("asks"), "id").agg(F.sort_array(F.flatten(F.collect_list(T.trigrams(F.col("name"))))).alias("grams"))
    side = lambda which, k, g: grams.filter(which).select(F.col("id").alias(k), F.col("grams").alias(g))
    left, right = side("asks", "query", "q"), side("not asks", "record", "r")
    train, q = records(spark, d).filter("src = 1"), blocking.postings(left, ["query"], F.col("q"))
    qp, rp = (blocking.postings(x.select(g).distinct(), [g], F.col(g)) for x, g in ((left, "q"), (right, "r")))
    df = blocking.document_frequency(blocking.postings(right, ["record"], F.col("r")))
    pairs = blocking.anchors(qp, df, "q", 8).select("q", "term").join(rp.select("r", "term"), "term").select("q", "r").distinct()
    idf = blocking.idf_table(q.select(F.col("query").alias("id"), "term"), train)
    scored = blocking.gram_cosine(pairs, qp, rp, "q", "r", idf, train)
    return _round(blocking.for_all(scored, left, right, "q", "r", "query", "record"))


# Features


@query(f"""WITH {CANDIDATES_SQL} SELECT pool, entity, score, rank, ROUND(COALESCE(MAX(score) FILTER (rank = 0) OVER p, 0) - score, 6) AS gap_top1, ROUND(COALESCE(MAX(score) FILTER (rank = 0) OVER p, 0) - COALESCE(MAX(score) FILTER (rank = 1) OVER p, 0), 6) AS margin12,
COUNT(*) OVER p AS ncand, CAST(SUM(CAST(rank = 0 AS INT)) OVER e AS BIGINT) AS s1_rank0_deg, COUNT(*) OVER e AS s1_cand_deg, ROUND(COALESCE(SUM(score) FILTER (rank = 0) OVER e, 0), 6) AS s1_claim,
ROW_NUMBER() OVER (PARTITION BY entity ORDER BY score DESC, pool, rank) - 1 AS s1_inrank, ROUND(MAX(score) OVER e - score, 6) AS s1_top_in_gap FROM pairs WINDOW p AS (PARTITION BY pool), e AS (PARTITION BY entity)""")
def context_features(spark, d):
    return _round(features.context(Candidates(spark, d).pairs, "pool", "entity"))


@query(f"WITH {CANDIDATES_SQL} SELECT pool, entity, score, ROUND(score - MAX(score) OVER (PARTITION BY pool), 6) AS score_rel FROM pairs")
def relative_features(spark, d):
    return _round(features.relative(Candidates(spark, d).pairs.select("pool", "entity", "score"), "pool", ["score"]))


@query(f"""{_TFIDF}, d AS (SELECT id, list_distinct(regexp_extract_all(name, '[0-9]+')) AS x, regexp_extract(name, '[0-9]+') AS f FROM records),
q AS (SELECT pool, entity, a.x, b.x AS y, a.f AS fx, b.f AS fy, len(list_intersect(a.x, b.x)) AS i FROM top JOIN d a ON a.id = pool JOIN d b ON b.id = entity WHERE rank < 10)
SELECT pool, entity, i AS num_inter, len(x) AS num_p, len(y) AS num_s, ROUND(i / GREATEST(len(x) + len(y) - i, 1), 6) AS num_jac, CAST(len(x) > 0 AND len(y) > 0 AND i = 0 AS BIGINT) AS num_conflict, CAST(len(x) > 0 AND i = len(x) AS BIGINT) AS num_p_subset,
CAST(fx <> '' AND fy <> '' AND CAST(NULLIF(fx, '') AS HUGEINT) = CAST(NULLIF(fy, '') AS HUGEINT) AS BIGINT) AS first_num_eq FROM q""")
def numeric_overlap_features(spark, d):
    every = texts(spark, d)
    numbers = every.select("id", F.concat_ws(" ", T.digit_runs(F.col("name"))).alias("numbers"))  # only the numbers are joined
    a = numbers.select(F.col("id").alias("pool"), F.col("numbers").alias("x"))
    b = numbers.select(F.col("id").alias("entity"), F.col("numbers").alias("y"))
    made = features.number_overlap(F.col("x"), F.col("y"))
    return _round(_top(every).join(a, "pool").join(b, "entity").select("pool", "entity", *(c.alias(n) for n, c in made.items())))


@query(f"WITH {_PAIRS} SELECT a, b, levenshtein(a, b) AS distance FROM part_pairs")
def levenshtein_pairs(spark, d):
    return _round(_part_pairs(spark, d).withColumn("distance", F.levenshtein("a", "b")))


@query(f"WITH {_PAIRS} SELECT a, b, ROUND(jaro_winkler_similarity(a, b), 6) AS similarity FROM part_pairs")
def jaro_winkler_pairs(spark, d):
    return _round(_part_pairs(spark, d).select("a", "b", S.pool_scores("a", "b")["jw"].alias("similarity")))


@query()
def fuzz_ratios(spark, d):
    return _round(_part_pairs(spark, d).withColumns({"s": S.staged_scores("a", "b"), "p": S.pool_scores("a", "b")}).select("a", "b", "s.*", "p.ratio", "p.tset", "p.tsort", "p.partial", "p.concat", "p.concat_partial"))


@query()
def nfkc_normalize(spark, d):
    return texts(spark, d).select("id", T.prepare("name").alias("name"), T.pool_record("name", "addr").alias("r")).select("id", "name", "r.nname", "r.naddr", F.array_join("r.toks", " ").alias("toks"))


@query()
def numeric_evidence(spark, d):
    view = records(spark, d).select("id", T.normalized_record("name", "addr").alias("r")).select("id", "r.*")
    return sinks.list_columns_as_json(view)


def _pair_frame(spark, d):
    """Candidate pairs of the similarity join with both normalised records; ranks and scores by route are those of the five-route retrieval, where it has the pair."""
    pairs = _top(records(spark, d)).select("pool", "entity", "score")
    found = _retrieved(spark, d).select(F.col("query").alias("entity"), F.col("record").alias("pool"), F.col("best_score").alias("_best"), "metadata")
    view = records(spark, d).select("id", F.col("src").alias("source"), T.normalized_record("name", "addr").alias("r"))
    a = view.select(F.col("id").alias("entity"), F.col("r").alias("s1"))
    b = view.select(F.col("id").alias("pool"), F.col("r").alias("cand"), "source")
    none = F.create_map().cast(dict(found.dtypes)["metadata"])
    joined = pairs.join(found, ["pool", "entity"], "left").join(a, "entity").join(b, "pool")
    return joined.select("pool", "entity", "s1", "cand", F.coalesce("_best", "score").alias("best_score"), F.coalesce("metadata", none).alias("metadata"), "source")


@query()
def staged_pair_features(spark, d):
    every = records(spark, d)
    rare = blocking.rare_terms(blocking.postings(every, ["id"], T.words(F.col("name"))), every, 0.01)
    return _round(features.staged_features(_pair_frame(spark, d), rare))


@query()
def pool_pair_features(spark, d):
    pairs = features.context(_top(records(spark, d)), "pool", "entity").join(records(spark, d).select(F.col("id").alias("pool"), "src"), "pool")
    view = records(spark, d).select("id", T.pool_record("name", "addr").alias("r"))
    side = lambda key, p: view.select(F.col("id").alias(key), F.col("r.nname").alias(f"{p}_name"), F.col("r.naddr").alias(f"{p}_addr"))
    full = features.pool_features(pairs.join(side("pool", "p"), "pool").join(side("entity", "s"), "entity"), "pool", "entity")
    n = records(spark, d).count()
    for prefix, column in (("a", "naddr"), ("n", "nname")):
        post = blocking.postings(view.select("id", F.col(f"r.{column}").alias("t")), ["id"], T.words(F.col("t")))
        full = features.weighted_cosine(full, post, blocking.document_frequency(post), n, "pool", "entity", "id", f"{prefix}_wcos")
    return _round(full)


MODEL_FEATURES = ["score", "rank", "gap_top1", "margin12", "ncand", "s1_rank0_deg", "s1_cand_deg", "s1_claim", "s1_inrank", "s1_top_in_gap"]


@query()
def gbt_scores(spark, d):
    c = Candidates(spark, d)
    pairs = features.context(c.pairs, "pool", "entity").join(c.truth.withColumn("label", F.lit(1.0)), ["pool", "entity"], "left").fillna(0.0, ["label"])
    scored = learning.cross_validated(pairs, MODEL_FEATURES, "entity", folds=5, rounds=10, depth=4)
    return _round(scored.select("pool", "entity", "label", "fold", "p"))


@query(f"""WITH {CANDIDATES_SQL} SELECT CASE WHEN entity % 2 = 0 THEN 'train' ELSE 'validation' END AS split, COUNT(*) AS pairs, CAST(SUM(y) AS BIGINT) AS positives, ROUND(AVG(y), 6) AS rate, COUNT(*) FILTER (y = 0 AND score > 0.8) AS hard_negatives,
ROUND(AVG(score), 6) AS score_mean, ROUND(stddev_pop(score), 6) AS score_std, ROUND(AVG(rank), 6) AS rank_mean, ROUND(stddev_pop(rank), 6) AS rank_std FROM (SELECT p.*, CASE WHEN t.pool IS NULL THEN 0 ELSE 1 END AS y FROM pairs p LEFT JOIN truth t USING (pool, entity)) GROUP BY 1""")
def pair_statistics(spark, d):
    c = Candidates(spark, d)
    pairs = c.pairs.join(c.truth.withColumn("y", F.lit(1)), ["pool", "entity"], "left").fillna(0, ["y"]).withColumn("split", F.when(F.col("entity") % 2 == 0, "train").otherwise("validation"))
    return _round(features.pair_statistics(pairs, "y", ["score", "rank"], "split", "score"))
