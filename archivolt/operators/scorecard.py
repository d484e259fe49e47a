"""Indicators: values, traffic lights, trends, alerts, scores and usage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.functions import fixed
from archivolt.operators import knowledge


def kpi_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.KPIS, "code string, perspective string, direction string, unit string, target double, amber double, red double, query_type string")


def state(value: Column, direction: Column, amber: Column, red: Column, strict: bool = False) -> Column:
    """green, amber, red, or gray without a value or thresholds.

    For lte the literal rule takes red as the inner bound; strict orders the
    two bounds first, so that either notation works.
    """
    inner, outer = (F.least(amber, red), F.greatest(amber, red)) if strict else (red, amber)
    up = F.when(value >= amber, "green").when(value >= red, "amber").otherwise("red")
    down = F.when(value <= inner, "green").when(value <= outer, "amber").otherwise("red")
    return F.when(value.isNull() | amber.isNull() | red.isNull(), "gray").when(direction == "gte", up).otherwise(down)


def normalised(value: Column, direction: Column, amber: Column, red: Column, target: Column) -> Column:
    """Value on 0 to 100 between the red and the amber bound."""
    top = F.when(direction == "gte", F.coalesce(amber, target)).otherwise(amber)
    up, down = F.try_divide((value - red) * 100, top - red), F.try_divide((red - value) * 100, red - top)
    raw = F.when(top.isNull() | red.isNull() | (top == red), value).when(direction == "gte", up).otherwise(down)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def score(values: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Consolidated score: mean of normalised values, weighted by perspective; 0 for no value."""
    known = values.where("value is not null")
    w = F.lit(1.0)
    for perspective, weight in (weights or {}).items():
        w = F.when(F.col("perspective") == perspective, F.lit(float(weight))).otherwise(w)
    n = normalised(*[F.col(c) for c in ("value", "direction", "amber", "red", "target")])
    sums = known.agg(F.sum(n * w).alias("a"), F.sum(w).alias("b"), F.count("*").alias("kpis"))
    return sums.select(F.round(F.coalesce(F.try_divide("a", "b"), F.lit(0.0)), 1).alias("score"), "kpis")


def evidence_stats(audit: DataFrame) -> DataFrame:
    """Queries in all, with and without a source, and the share with one."""
    q = audit.where("action = 'query'")
    s = q.agg(F.count("*").alias("total"), F.count_if(F.col("n_sources") > 0).alias("with_evidence"))
    pct = F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.try_divide(F.col("with_evidence") * 100.0, F.col("total")), 2))
    return s.select("total", "with_evidence", (F.col("total") - F.col("with_evidence")).alias("without_evidence"), pct.alias("pct"))


def newest(audit: DataFrame, cap: int | None, *actions: str) -> DataFrame:
    """The newest rows of some actions; all of them if cap is None."""
    rows = audit.where(F.col("action").isin(*actions)) if actions else audit
    return rows if cap is None else rows.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(cap)


def usage_per_user(audit: DataFrame) -> DataFrame:
    rows = audit.where("action in ('query', 'upload')")
    return rows.groupBy(F.coalesce("username", F.lit("anonimo")).alias("username")).agg(F.count_if(F.col("action") == "query").alias("queries"), F.count_if(F.col("action") == "upload").alias("uploads"))


def usage(audit: DataFrame) -> DataFrame:
    """Active users, and queries and uploads per user."""
    s = usage_per_user(audit).agg(F.count("*").alias("active_users"), F.coalesce(F.sum("queries"), F.lit(0)).alias("queries"), F.coalesce(F.sum("uploads"), F.lit(0)).alias("uploads"))
    per = lambda c: F.round(F.col(c) / F.greatest(F.lit(1), F.col("active_users")), 2)
    return s.select("*", per("queries").alias("queries_per_user"), per("uploads").alias("uploads_per_user"))


def feedback(messages: DataFrame) -> DataFrame:
    """Useful share of all feedback, and the rest."""
    s = messages.where("feedback is not null").agg(F.count("*").alias("total"), F.count_if(F.col("feedback") == "useful").alias("useful"))
    pct = F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.try_divide(F.col("useful") * 100.0, F.col("total")), 2))
    return s.select("total", "useful", pct.alias("useful_pct"), F.when(F.col("total") == 0, 0.0).otherwise(F.round(100 - pct, 2)).alias("not_useful_pct"))


def support(evidence: Column, keyword_hits: Column, mean_score: Column, pages: Column) -> Column:
    """Support index of 0 to 100 from evidence, keywords, mean score and pages."""
    one = F.lit(1.0)
    parts = 0.4 * F.least(one, evidence / 10) + 0.2 * F.least(one, keyword_hits / 10) + 0.2 * F.least(one, F.greatest(F.lit(0.0), mean_score)) + 0.2 * F.least(one, pages / 5)
    return F.round(parts * 100, 1)


def support_level(index: Column) -> Column:
    return F.when(index >= 70, "Alto").when(index >= 40, "Medio").otherwise("Bajo")


def kpi_parts(t: dict[str, DataFrame], cap: int | None = 500) -> dict[str, Callable[[], DataFrame]]:
    """The sources of the indicators: for each a plan of one row with a column for each code."""

    def docs() -> DataFrame:
        n = t["documents"].agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("done"))
        return n.select(F.col("n").cast("double").alias("DOC_TOTAL"), F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.try_divide(F.col("done") * 100.0, F.col("n")), 2)).alias("DOC_PROCESSED"))

    def cover() -> DataFrame:
        return knowledge.coverage(t["keywords"], t["chunk_keywords"]).select(F.col("coverage").alias("KEYWORD_COVERAGE"), (F.col("total") - F.col("found")).cast("double").alias("KEYWORD_GAPS"))

    def evidence() -> DataFrame:
        return evidence_stats(newest(t["audit"], cap, "query", "upload")).select(F.col("total").cast("double").alias("QUERY_TOTAL"), F.col("pct").alias("QUERY_WITH_EVIDENCE"), F.col("without_evidence").cast("double").alias("QUERY_NO_EVIDENCE"))

    def use() -> DataFrame:
        return usage(newest(t["audit"], cap, "query", "upload")).select(F.col("active_users").cast("double").alias("USAGE_ACTIVE_USERS"), F.col("queries_per_user").alias("USAGE_QUERIES_PER_USER"), F.col("uploads_per_user").alias("USAGE_DOCS_PER_USER"))

    def opinions() -> DataFrame:
        return feedback(t["messages"]).select(F.col("useful_pct").alias("FEEDBACK_USEFUL"), F.col("not_useful_pct").alias("FEEDBACK_UNUSEFUL"))

    def log() -> DataFrame:
        return t["audit"].agg(F.count("*").cast("double").alias("AUDIT_OPERATIONS"), F.count_if(F.col("action") == "login_failed").cast("double").alias("FAILED_LOGINS"))

    def users() -> DataFrame:
        return t["users"].agg(F.count("*").cast("double").alias("USERS_TOTAL"))

    return {"documents": docs, "coverage": cover, "evidence": evidence, "usage": use, "feedback": opinions, "log": log, "users": users}


def kpi_values(spark: SparkSession, t: dict[str, DataFrame], cap: int | None = 500) -> DataFrame:
    """All indicators with their values: one aggregate per source, one row per code."""
    long = [_by_code(part()) for part in kpi_parts(t, cap).values()]
    return F.broadcast(kpi_catalogue(spark)).join(reduce(DataFrame.unionByName, long), "code", "left")


def _by_code(p: DataFrame) -> DataFrame:
    return p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("value")) for c in p.columns])).alias("k")).select("k.*")


def kpi_values_isolated(spark: SparkSession, t: dict[str, DataFrame], cap: int | None = 500) -> tuple[DataFrame, dict[str, str]]:
    """The same, each source computed by itself: one that fails leaves its indicators null. Also the errors."""
    got, errors = [], {}
    for name, part in kpi_parts(t, cap).items():
        try:
            got += [tuple(r) for r in _by_code(part()).collect()]  # a few rows
        except Exception as e:  # isolation is the purpose
            errors[name] = str(e)[:200]
    values = spark.createDataFrame(got, "code string, value double")
    return F.broadcast(kpi_catalogue(spark)).join(values, "code", "left"), errors


def with_state(values: DataFrame, strict: bool = False) -> DataFrame:
    cols = [F.col(c) for c in ("value", "direction", "amber", "red")]
    return values.withColumn("state", state(*cols, strict)).withColumn("normal", F.round(normalised(*cols, F.col("target")), 4))


def rollup(states: DataFrame) -> DataFrame:
    """Per perspective: the worst state, counts of each, and the codes that need attention."""
    order = F.create_map(*[F.lit(x) for p in {"gray": 0, "green": 1, "amber": 2, "red": 3}.items() for x in p])
    worst = F.element_at(F.array(*map(F.lit, ("gray", "green", "amber", "red"))), F.max(order[F.col("state")]) + 1)
    n = [F.count_if(F.col("state") == s).alias(s) for s in ("green", "amber", "red", "gray")]
    attention = F.array_join(F.sort_array(F.collect_list(F.when(F.col("state").isin("amber", "red"), F.col("code")))), ",").alias("attention")
    return states.groupBy("perspective").agg(worst.alias("worst"), *n, attention)


def trend(snapshots: DataFrame, direction: Column | None = None) -> DataFrame:
    """Latest value of each indicator, its change and whether that is better."""
    w = Window.partitionBy("kpi").orderBy(F.desc("computed_at"))
    two = snapshots.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    v = two.groupBy("kpi").agg(F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("_r") == 2, F.col("value"))).alias("previous"))
    delta = F.round(F.col("value") - F.col("previous"), 2)
    v = v.withColumn("delta", delta).withColumn("arrow", F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat"))
    up = (direction if direction is not None else F.lit("gte")) == "gte"
    return v.withColumn("improved", F.when(F.col("delta") == 0, None).otherwise((F.col("delta") > 0) == up))


def new_alerts(states: DataFrame, open_alerts: DataFrame, per_severity: bool = False) -> DataFrame:
    """Alerts for amber (warning) and red (critical) indicators that have none open.

    per_severity compares only with open alerts of the same severity.
    """
    severity = F.when(F.col("state") == "amber", "warning").when(F.col("state") == "red", "critical")
    wanted = states.select("code", severity.alias("severity")).where("severity is not null")
    keys = ["code", "severity"] if per_severity else ["code"]
    return wanted.join(open_alerts.where("status = 'open'").select(*keys).distinct(), keys, "left_anti")


def resolve_alerts(alerts: DataFrame, codes: list[str], by: str) -> DataFrame:
    hit = F.col("code").isin(codes) & (F.col("status") == "open")
    return alerts.withColumn("resolved_by", F.when(hit, F.lit(by)).otherwise(F.col("resolved_by"))).withColumn("status", F.when(hit, "resolved").otherwise(F.col("status")))
