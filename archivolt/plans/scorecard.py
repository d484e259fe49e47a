"""Queries of the scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import fixed
from archivolt.operators import scorecard as s
from archivolt.plans.catalog import query
from archivolt.plans.knowledge import COVER


def _v(x) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)"


KPIS = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_v, row)) + ")" for row in fixed.KPIS) + ") AS t(code, perspective, direction, unit, target, amber, red, query_type))"
NEWEST = "(SELECT * FROM audit WHERE action IN ('query', 'upload') ORDER BY created_at DESC, audit_id DESC LIMIT 500)"
STATS = "SELECT count(*) AS total, count(*) FILTER (WHERE n_sources > 0) AS with_evidence, count(*) FILTER (WHERE NOT coalesce(n_sources > 0, false)) AS without_evidence, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (WHERE n_sources > 0) * 100.0 / count(*), 2) END AS DOUBLE) AS pct FROM {audit} WHERE action = 'query'"
PER_USER = "SELECT coalesce(username, 'anonimo') AS username, count(*) FILTER (WHERE action = 'query') AS queries, count(*) FILTER (WHERE action = 'upload') AS uploads FROM {audit} WHERE action IN ('query', 'upload') GROUP BY 1"
USAGE = "SELECT count(*) AS active_users, CAST(coalesce(sum(queries), 0) AS BIGINT) AS queries, CAST(coalesce(sum(uploads), 0) AS BIGINT) AS uploads, CAST(round(coalesce(sum(queries), 0) / greatest(1, count(*)), 2) AS DOUBLE) AS queries_per_user, CAST(round(coalesce(sum(uploads), 0) / greatest(1, count(*)), 2) AS DOUBLE) AS uploads_per_user FROM ({per})"
FEED = "SELECT total, useful, pct AS useful_pct, CASE WHEN total = 0 THEN 0.0 ELSE round(100 - pct, 2) END AS not_useful_pct FROM (SELECT count(*) AS total, count(*) FILTER (WHERE feedback = 'useful') AS useful, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (WHERE feedback = 'useful') * 100.0 / count(*), 2) END AS DOUBLE) AS pct FROM messages WHERE feedback IS NOT NULL)"
VALUES = f"""(SELECT 'DOC_TOTAL' AS code, CAST(count(*) AS DOUBLE) AS value FROM docs
UNION ALL SELECT 'DOC_PROCESSED', CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE status = 'completed') * 100.0 / count(*), 2) END FROM docs
UNION ALL SELECT 'KEYWORD_COVERAGE', coverage FROM ({COVER}) UNION ALL SELECT 'KEYWORD_GAPS', total - found FROM ({COVER})
UNION ALL SELECT unnest(['QUERY_TOTAL', 'QUERY_WITH_EVIDENCE', 'QUERY_NO_EVIDENCE']), unnest([CAST(total AS DOUBLE), pct, CAST(without_evidence AS DOUBLE)]) FROM ({STATS.format(audit=NEWEST)})
UNION ALL SELECT unnest(['USAGE_ACTIVE_USERS', 'USAGE_QUERIES_PER_USER', 'USAGE_DOCS_PER_USER']), unnest([CAST(active_users AS DOUBLE), queries_per_user, uploads_per_user]) FROM ({USAGE.format(per=PER_USER.format(audit=NEWEST))})
UNION ALL SELECT unnest(['FEEDBACK_USEFUL', 'FEEDBACK_UNUSEFUL']), unnest([useful_pct, not_useful_pct]) FROM ({FEED})
UNION ALL SELECT 'AUDIT_OPERATIONS', count(*) FROM audit UNION ALL SELECT 'FAILED_LOGINS', count(*) FROM audit WHERE action = 'login_failed'
UNION ALL SELECT 'USERS_TOTAL', count(DISTINCT user_id) FROM events)"""
STATE = "CASE WHEN value IS NULL OR amber IS NULL OR red IS NULL THEN 'gray' WHEN direction = 'gte' THEN CASE WHEN value >= amber THEN 'green' WHEN value >= red THEN 'amber' ELSE 'red' END ELSE CASE WHEN value <= red THEN 'green' WHEN value <= amber THEN 'amber' ELSE 'red' END END"
TOP = "CASE WHEN direction = 'gte' THEN coalesce(amber, target) ELSE amber END"
NORMAL = f"greatest(0.0, least(100.0, CASE WHEN {TOP} IS NULL OR red IS NULL OR {TOP} = red THEN value WHEN direction = 'gte' THEN (value - red) * 100 / ({TOP} - red) ELSE (red - value) * 100 / (red - ({TOP})) END))"
STATES = f"(SELECT k.*, value, {STATE} AS state FROM {KPIS} k LEFT JOIN {VALUES} v ON v.code = k.code)"
NEED = ("ck", "docs", "audit", "messages")


@query(STATS.format(audit="audit"), "audit")
def query_evidence_stats(t):
    return s.evidence_stats(t.audit)


@query(PER_USER.format(audit="audit"), "audit")
def usage_per_user(t):
    return s.usage_per_user(t.audit)


@query(USAGE.format(per=PER_USER.format(audit="audit")), "audit")
def usage_summary(t):
    return s.usage(t.audit)


@query(FEED, "messages")
def feedback_pct(t):
    return s.feedback(t.messages)


@query(f"SELECT code, perspective, value FROM {STATES}", *NEED)
def kpi_values(t):
    return s.kpi_values(t.spark, t.all()).select("code", "perspective", "value")


@query(f"SELECT code, state, round({NORMAL}, 4) AS normal FROM {STATES}", *NEED)
def kpi_state(t):
    return s.with_state(s.kpi_values(t.spark, t.all())).select("code", "state", "normal")


@query(f"SELECT code, CASE WHEN direction = 'lte' THEN CASE WHEN value <= least(amber, red) THEN 'green' WHEN value <= greatest(amber, red) THEN 'amber' ELSE 'red' END ELSE state END AS state FROM {STATES}", *NEED)
def kpi_state_strict(t):
    return s.with_state(s.kpi_values(t.spark, t.all()), strict=True).select("code", "state")


@query(f"SELECT round(coalesce(sum(n * w) / sum(w), 0), 1) AS score, count(*) AS kpis FROM (SELECT {NORMAL} AS n, CASE perspective WHEN 'rag' THEN 2.0 ELSE 1.0 END AS w FROM {STATES} WHERE value IS NOT NULL)", *NEED)
def kpi_score(t):
    return s.score(s.kpi_values(t.spark, t.all()), {"rag": 2.0})


@query(f"""SELECT perspective, ['gray', 'green', 'amber', 'red'][max(CASE state WHEN 'gray' THEN 1 WHEN 'green' THEN 2 WHEN 'amber' THEN 3 ELSE 4 END)] AS worst, count(*) FILTER (WHERE state = 'green') AS green, count(*) FILTER (WHERE state = 'amber') AS amber,
count(*) FILTER (WHERE state = 'red') AS red, count(*) FILTER (WHERE state = 'gray') AS gray, coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE state IN ('amber', 'red')), '') AS attention FROM {STATES.replace('AS state', 'AS state')} GROUP BY perspective""", *NEED)
def perspective_rollup(t):
    return s.rollup(s.with_state(s.kpi_values(t.spark, t.all())))


@query(f"SELECT code, CASE state WHEN 'amber' THEN 'warning' ELSE 'critical' END AS severity FROM {STATES} WHERE state IN ('amber', 'red') AND code <> 'FEEDBACK_USEFUL'", *NEED)
def alert_new(t):
    there = t.spark.sql("SELECT * FROM VALUES ('FEEDBACK_USEFUL', 'info', 'open'), ('KEYWORD_COVERAGE', 'warning', 'resolved') AS t(code, severity, status)")
    return s.new_alerts(s.with_state(s.kpi_values(t.spark, t.all())), there)


@query(""", two AS (SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY computed_at DESC) AS r FROM snapshots QUALIFY r <= 2),
v AS (SELECT kpi, max(value) FILTER (WHERE r = 1) AS value, max(value) FILTER (WHERE r = 2) AS previous FROM two GROUP BY kpi), d AS (SELECT *, round(value - previous, 2) AS delta FROM v)
SELECT kpi, value, previous, delta, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' WHEN delta = 0 THEN 'flat' END AS arrow, CASE WHEN delta = 0 THEN NULL ELSE delta > 0 END AS improved FROM d""", "snapshots")
def kpi_trend(t):
    return s.trend(t.snapshots)


@query("""SELECT username, round((0.4 * least(1.0, ev / 10.0) + 0.2 * least(1.0, kw / 10.0) + 0.2 * least(1.0, greatest(0.0, av)) + 0.2 * least(1.0, pg / 5.0)) * 100, 1) AS support
FROM (SELECT username, CAST(count(*) FILTER (WHERE n_sources > 0) AS DOUBLE) AS ev, CAST(max(n_sources) AS DOUBLE) AS kw, 0.5 AS av, CAST(count(DISTINCT n_sources) AS DOUBLE) AS pg FROM audit WHERE action = 'query' AND username IS NOT NULL GROUP BY username)""", "audit")
def support_index(t):
    u = t.audit.where("action = 'query' and username is not null").groupBy("username").agg(F.count_if(F.col("n_sources") > 0).alias("ev"), F.max("n_sources").alias("kw"), F.countDistinct("n_sources").alias("pg"))
    return u.select("username", s.support(F.col("ev"), F.col("kw"), F.lit(0.5), F.col("pg")).alias("support"))


@query("SELECT round(avg(n_sources), 2) AS mean_sources, count(*) AS queries FROM (SELECT * FROM audit WHERE action = 'query' ORDER BY created_at DESC, audit_id DESC LIMIT 50)", "audit")
def support_recent(t):
    return s.newest(t.audit, 50, "query").agg(F.round(F.avg("n_sources"), 2).alias("mean_sources"), F.count("*").alias("queries"))
