"""Usage, cost and latency analytics over traces, calls and spans."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from raglens.functions.scalars import cost_label, mean_present, ratio, title_fingerprint, normalised, token_efficiency, estimate_tokens, window_label
from raglens.operators.percentiles import percentiles, with_percentiles

#: Digits of rounded means and percentiles.
DIGITS = 6


@dataclass(frozen=True)
class Scope:
    """Time window (both ends included) and tenant. start, end: timestamps as text."""

    start: str | None = None
    end: str | None = None
    application_id: int | None = None
    organization_id: int | None = None
    unit: str = field(default="day")

    def holds(self, ts: str) -> Column:
        """Whether a time is in the window; false for none."""
        out = F.col(ts).isNotNull()
        if self.start is not None:
            out = out & (F.col(ts) >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end is not None:
            out = out & (F.col(ts) <= F.lit(self.end).cast("timestamp_ntz"))
        return F.coalesce(out, F.lit(False))

    def rows(self, df: DataFrame, ts: str, applications: DataFrame | None = None, app: str = "application_id") -> DataFrame:
        """The one place that filters on window, application and organization."""
        if self.start is not None:
            df = df.where(F.col(ts) >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end is not None:
            df = df.where(F.col(ts) <= F.lit(self.end).cast("timestamp_ntz"))
        if self.application_id is not None:
            df = df.where(F.col(app) == self.application_id)
        if self.organization_id is not None:
            own = applications.where(F.col("organization_id") == self.organization_id).select(F.col("id").alias("_own"))
            df = df.join(own, df[app] == own["_own"], "left_semi")
        return df


def money(c: str) -> Column:
    """Exact sum of a column of cents."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def mean(c: str) -> Column:
    return F.round(F.avg(c), DIGITS)


def exact_mean(c: str) -> Column:
    return F.round(F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(c), DIGITS)


def call_measures() -> dict[str, Column]:
    """Of calls or any group of them; sums of nothing are 0, means of nothing NULL."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = F.col("input_tokens") + F.col("output_tokens")
    return {
        "calls": F.count("*"),
        "errors": F.count_if(F.col("status") == "error"),
        "input_tokens": zero(F.sum("input_tokens")),
        "output_tokens": zero(F.sum("output_tokens")),
        "total_tokens": zero(F.sum(both)),
        "cost": F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)),
        "max_tokens": F.max(both),
        "avg_latency_ms": exact_mean("latency_ms"),
    }


def trace_measures() -> dict[str, Column]:
    """Of traces or any group of them; error_rate is 0.0 where there are none."""
    n, bad = F.count("*"), F.count_if(has_error())
    return {"traces": n, "errors": bad, "users": F.countDistinct("user_id"), "avg_duration_ms": exact_mean("duration_ms"), "max_duration_ms": F.max("duration_ms"), "error_rate": ratio(bad.cast("double"), n)}


def call_summary(calls: DataFrame) -> DataFrame:
    """One row; sums of nothing are 0, means and percentiles of nothing NULL."""
    one = calls.agg(*(c.alias(n) for n, c in call_measures().items()))
    one = with_percentiles(one, calls, "latency_ms", {f"p{p}_latency_ms": p / 100 for p in (50, 95, 99)})
    return with_percentiles(one, calls, F.col("input_tokens") + F.col("output_tokens"), {f"p{p}_tokens": p / 100 for p in (50, 95, 99)})


def trace_summary(traces: DataFrame) -> DataFrame:
    one = traces.agg(*(c.alias(n) for n, c in trace_measures().items()))
    return with_percentiles(one, traces, "duration_ms", {f"p{p}_duration_ms": p / 100 for p in (50, 95, 99)})


def trace_totals(traces: DataFrame, calls: DataFrame) -> DataFrame:
    """Traces with the sums of their calls; 0 without calls."""
    g = calls.groupBy(F.col("trace_id").alias("_t")).agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("cost").alias("c"), F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    out = traces.join(g, F.col("trace_id") == F.col("_t"), "left")
    return out.select(traces["*"], F.coalesce("n", zero).alias("calls"), F.coalesce("i", zero).alias("input_tokens"), F.coalesce("o", zero).alias("output_tokens"), (F.coalesce("i", zero) + F.coalesce("o", zero)).alias("total_tokens"), F.coalesce("c", F.lit(0).cast("decimal(20,4)")).alias("cost"))


def has_error() -> Column:
    return (F.coalesce(F.col("error"), F.lit("")) != "") | (F.col("status") == "error")


def bucket(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def bucket_series(spark, scope: Scope) -> DataFrame:
    """Every bucket from the truncated start to the truncated end."""
    step = {"hour": "interval 1 hour", "day": "interval 1 day"}[scope.unit]
    ends = spark.range(1).select(*(F.date_trunc(scope.unit, F.lit(x).cast("timestamp_ntz")).cast("timestamp_ntz").alias(n) for n, x in (("a", scope.start), ("b", scope.end))))
    return ends.select(F.explode(F.sequence("a", "b", F.expr(step))).alias("bucket"))


def series(spark, spans: DataFrame, scope: Scope) -> DataFrame:
    """Spans by bucket without gaps: an empty bucket's measures stay NULL. The series() of
    telemetry as a whole is usage_series()."""
    by = (
        scope.rows(spans, "start_time")
        .groupBy(bucket("start_time", scope.unit).alias("bucket"))
        .agg(F.count("*").alias("spans"), F.count_if("failed").alias("errors"), mean("duration_ms").alias("avg_duration_ms"))
    )
    rows = scope.rows(spans, "start_time").select(bucket("start_time", scope.unit).alias("bucket"), "duration_ms")
    by = with_percentiles(by, rows, "duration_ms", {"p95_duration_ms": 0.95}, ("bucket",))
    return bucket_series(spark, scope).join(by, "bucket", "left")


def usage_series(spark, calls: DataFrame, traces: DataFrame, retrievals: DataFrame, answers: DataFrame, scope: Scope) -> DataFrame:
    """Buckets of a window without gaps, each with what calls, traces, retrievals and judged
    answers say of it; what a bucket lacks is NULL."""
    unit = scope.unit
    by = lambda df, ts: scope.rows(df, ts).groupBy(bucket(ts, unit).alias("bucket"))
    c = by(calls, "created_at").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost").cast("double").alias("cost"), F.count_if(F.col("status") == "error").alias("call_errors"))
    t = by(traces, "start_time").agg(F.count("*").alias("traces"), F.count_if(has_error()).alias("trace_errors"), exact_mean("duration_ms").alias("avg_duration_ms"))
    r = by(retrievals, "created_at").agg(mean("top_score").alias("retrieval_score"))
    a = by(answers, "created_at").agg(mean("faithfulness").alias("faithfulness"), mean("answer_relevance").alias("answer_relevance"))
    out = bucket_series(spark, scope)
    for one in (c, t, r, a):
        out = out.join(one, "bucket", "left")
    return out


def by_user(traces: DataFrame, limit: int = 50) -> DataFrame:
    """Users by tokens. traces: trace_totals()."""
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("(anonymous)")).alias("user")
    g = traces.groupBy(user).agg(F.count("*").alias("traces"), F.sum("total_tokens").alias("tokens"), F.sum("cost").cast("double").alias("cost"), money("duration_ms").alias("total_ms"))
    return g.orderBy(F.desc("tokens"), "user").limit(limit)


def by_application(traces: DataFrame, applications: DataFrame) -> DataFrame:
    """traces: trace_totals()."""
    g = traces.groupBy("application_id").agg(F.count("*").alias("traces"), F.count_if(has_error()).alias("errors"), F.countDistinct("user_id").alias("users"), F.sum("total_tokens").alias("tokens"), F.sum("cost").cast("double").alias("cost"), money("duration_ms").alias("total_ms"))
    return g.join(applications, g.application_id == applications.id).select("name", "traces", "errors", "users", "tokens", "cost", "total_ms")


def by_model(calls: DataFrame, limit: int = 100) -> DataFrame:
    g = calls.groupBy("model", "provider").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost").cast("double").alias("cost"), F.count_if(F.col("status") == "error").alias("errors"))
    return with_percentiles(g, calls, "latency_ms", {"p95_latency_ms": 0.95}, ("model", "provider")).orderBy(F.desc("tokens"), "model", "provider").limit(limit)


def by_span_kind(spans: DataFrame) -> DataFrame:
    tokens = F.get_json_object("attributes", "$.k").try_cast("double")
    g = spans.groupBy("kind").agg(F.count("*").alias("spans"), F.sum(tokens).alias("tokens"), mean("duration_ms").alias("avg_ms"), F.round(F.sum("duration_ms"), 4).alias("total_ms"), F.count_if("failed").alias("errors"))
    return with_percentiles(g, spans, "duration_ms", {"p95_ms": 0.95}, ("kind",))


def user_catalog(users: DataFrame, traces: DataFrame, limit: int = 100) -> DataFrame:
    """Users with lifetime counts; a silent user has 0 traces and no last time."""
    g = traces.groupBy("user_id").agg(F.count("*").alias("n"), F.max("start_time").alias("last_seen"))
    return users.join(g, users.id == g.user_id, "left").select("external_id", F.coalesce("n", F.lit(0)).alias("traces"), "last_seen").orderBy(F.desc("traces"), "external_id").limit(limit)


def application_catalog(applications: DataFrame, traces: DataFrame) -> DataFrame:
    g = traces.groupBy("application_id").agg(F.count("*").alias("traces"), F.max("start_time").alias("last_trace"))
    return applications.join(g, applications.id == g.application_id, "left").select("name", "organization_id", "traces", "last_trace")


def organization_counts(organizations: DataFrame, applications: DataFrame, keys: DataFrame) -> DataFrame:
    """The organizations with their numbers of applications and of keys, 0 without any."""
    each = lambda rows, name: rows.groupBy(F.col("organization_id").alias("id")).agg(F.count("*").alias(name))
    out = organizations.join(each(applications, "applications"), "id", "left").join(each(keys, "api_keys"), "id", "left")
    return out.fillna(0, ["applications", "api_keys"])


def model_comparison(calls: DataFrame, models: DataFrame) -> DataFrame:
    tokens = F.sum(F.col("input_tokens") + F.col("output_tokens"))
    g = calls.groupBy("provider", "model").agg(F.count("*").alias("calls"), tokens.alias("tokens"), F.sum("cost").cast("double").alias("cost"), exact_mean("latency_ms").alias("avg_latency_ms"))
    m = models.select(F.col("provider").alias("_p"), F.col("name").alias("_n"), "context_window", "is_local")
    return g.join(m, (g.provider == m["_p"]) & (g.model == m["_n"]), "left").select("provider", "model", "calls", "tokens", "cost", "avg_latency_ms", F.round(F.try_divide(F.col("cost") * 1000, F.col("tokens")), 8).alias("cost_per_1k_tokens"), "context_window", "is_local")


def last_call_per_trace(calls: DataFrame) -> DataFrame:
    w = Window.partitionBy("trace_id").orderBy(F.desc("created_at"), F.desc("call_no"), "model", "provider")
    return calls.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("trace_id", "call_no", "model", "provider", "created_at")


def top_offenders(calls: DataFrame, limit: int = 10) -> DataFrame:
    """Traces by tokens that brought no output."""
    g = calls.groupBy("trace_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    waste = F.greatest(F.lit(0).cast("long"), F.col("input_tokens") - F.col("output_tokens"))
    return g.withColumn("waste", waste).orderBy(F.desc("waste"), "trace_id").limit(limit)


def error_breakdown(traces: DataFrame) -> DataFrame:
    return traces.where(has_error()).groupBy(F.coalesce("error", F.lit("unclassified")).alias("error")).agg(F.count("*").alias("traces"))


def latency_percentiles(traces: DataFrame) -> DataFrame:
    return with_percentiles(traces.agg(F.count("duration_ms").alias("n")), traces, "duration_ms", {"p50": 0.5, "p95": 0.95})


def max_latency(calls: DataFrame) -> DataFrame:
    return calls.agg(F.coalesce(F.max("latency_ms"), F.lit(0.0)).alias("max_latency_ms"))


def retrieval_score(retrievals: DataFrame) -> DataFrame:
    return retrievals.agg(F.count("top_score").alias("scored"), mean("top_score").alias("retrieval_score"))


def answer_quality(answers: DataFrame, runs: DataFrame) -> DataFrame:
    """Means of the answers whose run is among `runs` (run_id)."""
    own = answers.join(runs.select("run_id"), "run_id", "left_semi")
    return own.agg(F.count("*").alias("answers"), mean("faithfulness").alias("faithfulness"), mean("answer_relevance").alias("answer_relevance"))


def quality_by_model(answers: DataFrame, traces: DataFrame, calls: DataFrame) -> DataFrame:
    """Mean quality - of what was measured of faithfulness and relevance - of the model that
    answered, which is that of a trace's last call."""
    last = last_call_per_trace(calls).select("trace_id", "model", "provider")
    q = answers.join(traces.select("trace_id"), "trace_id").join(last, "trace_id").withColumn("q", mean_present(F.col("faithfulness"), F.col("answer_relevance")))
    # sums of decimals don't depend on the order of the rows
    exact = F.sum(F.col("q").cast("decimal(18,12)")).cast("double") / F.count("q")
    return q.groupBy("model", "provider").agg(F.count("q").alias("answers"), F.round(exact, 9).alias("quality"))


def cost_quality(calls: DataFrame, models: DataFrame, quality: DataFrame) -> DataFrame:
    """model_comparison() with quality, and whether a model is the cheapest for each token or
    the best; only measured models compete, ties go to the first name."""
    q = quality.select(F.col("provider").alias("_p"), F.col("model").alias("_m"), "answers", "quality")
    rows = model_comparison(calls, models)
    rows = rows.join(q, (F.col("provider") == F.col("_p")) & (F.col("model") == F.col("_m")), "left").drop("_p", "_m")
    name = F.struct("provider", "model")
    best = rows.agg(F.min(F.when(F.col("cost_per_1k_tokens").isNotNull(), F.struct("cost_per_1k_tokens", "provider", "model"))).alias("_v"), F.min(F.when(F.col("quality").isNotNull(), F.struct((-F.col("quality")).alias("q"), "provider", "model"))).alias("_q"))
    is_ = lambda c: F.coalesce((F.col(f"{c}.provider") == F.col("provider")) & (F.col(f"{c}.model") == F.col("model")), F.lit(False))
    return rows.join(F.broadcast(best)).select("provider", "model", "calls", "tokens", "cost", "avg_latency_ms", "cost_per_1k_tokens", "answers", "quality", cost_label(F.col("is_local").isNotNull(), F.col("is_local")).alias("label"), is_("_v").alias("best_value"), is_("_q").alias("best_quality"))


def _marked(documents: DataFrame, key: tuple[str, ...], more: dict[str, Column]) -> DataFrame:
    """key, document_id, whether it is a duplicate, and sums of more, one row for each document
    of a retrieval. One shuffle: all counts and groups below are by the key or more."""
    w = Window.partitionBy(*key)
    prints = F.array(title_fingerprint(F.col("title")), normalised(F.col("content")))
    d = documents.select(*key, "document_id", prints.alias("_p"), *(c.alias(n) for n, c in more.items()))
    d = d.withColumn("_n", F.count("*").over(w)).withColumn("_same", F.count("*").over(Window.partitionBy(*key, "document_id")))
    d = d.select(*key, "document_id", "_n", "_same", *more, F.posexplode("_p").alias("_i", "_f"))
    like = (F.length("_f") >= 3) & (F.count("*").over(Window.partitionBy(*key, "_f")) > 1) & F.col("document_id").isNotNull()
    hit = (F.col("_n") > 1) & ((F.col("_same") > 1) | F.coalesce(like, F.lit(False)))
    once = {n: F.sum(F.when(F.col("_i") == 0, F.col(n))) for n in more}
    return d.withColumn("_hit", hit).groupBy(*key, "document_id").agg(F.max("_hit").alias("duplicate"), *(c.alias(n) for n, c in once.items()))


def duplicate_documents(documents: DataFrame, key: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """key, document_id of the documents of a retrieval that are there twice, or share the
    fingerprint of a title or content, of 3 characters or more, with another of its rows or
    their own other text. A retrieval of one document has none. The rows of one retrieval are
    one task's, sorted and spilled there; ingest has them all in one row of a payload."""
    return _marked(documents, key, {}).where("duplicate").select(*key, "document_id")


def document_facts(documents: DataFrame) -> DataFrame:
    """One row per trace with documents: documents, context_tokens, duplicates, and of its
    retrieval created_at (the earliest) and top_score."""
    w = Window.partitionBy("trace_id")
    seen = documents.withColumn("_at", F.min("created_at").over(w)).withColumn("_top", F.max("final_score").over(w))
    marked = _marked(seen, ("trace_id", "_at", "_top"), {"_tokens": estimate_tokens(F.col("content")), "_one": F.lit(1)})
    return marked.groupBy("trace_id").agg(F.sum("_one").alias("documents"), F.sum("_tokens").alias("context_tokens"), F.count_if("duplicate").alias("duplicates"), F.first("_at").alias("created_at"), F.first("_top").alias("top_score"))


def trace_analysis(calls: DataFrame, documents: DataFrame) -> DataFrame:
    """Token efficiency of every trace that has calls or documents: trace_id, documents,
    input_tokens, output_tokens, context_tokens and the fields of token_efficiency()."""
    c = calls.groupBy("trace_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    w = _marked(documents, ("trace_id",), {"_tokens": estimate_tokens(F.col("content")), "_one": F.lit(1)})
    d = w.groupBy("trace_id").agg(F.sum("_one").alias("documents"), F.sum("_tokens").alias("context_tokens"), F.count_if("duplicate").alias("duplicates"))
    return analysed(c.join(d, "trace_id", "full"))


def efficiency() -> Column:
    """token_efficiency() of a trace with the sums of its calls and documents, NULL for none."""
    each = (F.coalesce(F.col(x), F.lit(0).cast("long")) for x in ("input_tokens", "context_tokens", "output_tokens", "documents", "duplicates"))
    return token_efficiency(*each)


def analysed(facts: DataFrame) -> DataFrame:
    """trace_analysis() of traces with the sums of their calls and documents, NULL for none."""
    zero = F.lit(0).cast("long")
    return facts.select("trace_id", *(F.coalesce(x, zero).alias(x) for x in ("documents", "input_tokens", "output_tokens", "context_tokens")), efficiency().alias("e")).select("trace_id", "documents", "input_tokens", "output_tokens", "context_tokens", "e.*")


def efficiency_means() -> dict[str, Column]:
    return {"scored": F.count("score")} | {f"avg_{c}": mean(c) for c in ("score", "duplicate_ratio", "context_share", "output_yield", "potential_waste_pct", "wasted_tokens")}


def token_efficiency_rollup(analysis: DataFrame) -> DataFrame:
    """Means over the scored traces, and their number."""
    return analysis.agg(*(c.alias(n) for n, c in efficiency_means().items()))


def wasteful_traces(analysis: DataFrame, limit: int = 10) -> DataFrame:
    """Scored traces by wasted tokens."""
    return analysis.where("score is not null").orderBy(F.desc("wasted_tokens"), "trace_id").limit(limit).select("trace_id", "wasted_tokens", F.round("score", 4).alias("score"))


def waste_by_application(analysis: DataFrame, traces: DataFrame, applications: DataFrame) -> DataFrame:
    """name, traces, avg_waste_pct, wasted_tokens, most wasted first."""
    g = analysis.where("score is not null").join(traces.select("trace_id", "application_id"), "trace_id").groupBy("application_id").agg(F.count("*").alias("traces"), mean("potential_waste_pct").alias("avg_waste_pct"), F.sum("wasted_tokens").alias("wasted_tokens"))
    return g.join(applications, g.application_id == applications.id).select("name", "traces", "avg_waste_pct", "wasted_tokens").orderBy(F.desc("wasted_tokens"), "name")


def open_insights(anomalies: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Numbers of what isn't settled, whenever it was found."""
    a = anomalies.agg(F.count_if(~F.col("resolved")).alias("open_anomalies"))
    r = recommendations.agg(F.count_if(~F.col("dismissed")).alias("open_recommendations"))
    return a.join(F.broadcast(r))  # one row each


def findings(table: DataFrame, applications: DataFrame, order: list[Column], where: Column | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of anomalies or recommendations with their application's name, NULL if unknown."""
    rows = table if where is None else table.where(where)
    named = rows.join(F.broadcast(applications.select(F.col("id").alias("_a"), F.col("name").alias("application"))), F.col("application_id") == F.col("_a"), "left").drop("_a")
    size, page = min(500, max(1, size)), max(1, page)
    return named.orderBy(*order).offset((page - 1) * size).limit(size)


def resolved(anomalies: DataFrame, ids: DataFrame, flag: bool = True) -> DataFrame:
    """The anomalies with the flag set on those of ids (id)."""
    hit = ids.select(F.col("id").alias("_i")).distinct()
    return anomalies.join(hit, F.col("id") == F.col("_i"), "left").withColumn("resolved", F.when(F.col("_i").isNotNull(), flag).otherwise(F.col("resolved"))).drop("_i")


#: Seconds of the named windows; fixed values.
WINDOWS = {"1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000, "90d": 7776000}


def window_of(label: str, as_of: str, start: str | None = None, end: str | None = None) -> tuple[Scope, str]:
    """The scope and label of a named window that ends at as_of. A start of one's own makes it
    `custom`; an unknown label has the width of 7d. Short and custom windows have hourly buckets."""
    last = datetime.fromisoformat(end or as_of)
    name = "custom" if start else label
    first = datetime.fromisoformat(start) if start else last - timedelta(seconds=WINDOWS.get(label, WINDOWS["7d"]))
    return Scope(str(first), str(last), unit="hour" if name in ("1h", "24h", "custom") else "day"), name


def matching_traces(traces: DataFrame, calls: DataFrame | None = None, model: str | None = None, status: str | None = None, kind: str | None = None, user: int | None = None, has_errors: bool | None = None, least_ms: float | None = None, most_ms: float | None = None, least_tokens: int | None = None, search: str | None = None, columns: tuple[str, ...] = ("error",)) -> DataFrame:
    """The traces that meet all conditions given. search: part of one of
    `columns`, whatever the case; % and _ in it stand for any characters and any character."""
    kept = traces
    for value, test in (
        (status, F.col("status") == status),
        (kind, F.col("kind") == kind),
        (user, F.col("user_id") == user),
        (has_errors, has_error() == F.lit(has_errors)),
        (least_ms, F.col("duration_ms") >= least_ms),
        (most_ms, F.col("duration_ms") <= most_ms),
        (least_tokens, F.col("total_tokens") >= least_tokens if least_tokens is not None else None),
    ):
        if value is not None:
            kept = kept.where(test)
    if search is not None:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.col(c).ilike(f"%{search}%"), F.lit(False))
        kept = kept.where(found)
    if model is not None:
        kept = kept.join(calls.where(F.col("model") == model).select("trace_id"), "trace_id", "left_semi")
    return kept


_LISTED = ("trace_id", "start_time", "duration_ms", "kind")


def trace_list(traces: DataFrame, *args, page: int = 1, size: int = 50, **conditions) -> DataFrame:
    """A page of matching_traces(), newest first."""
    kept = matching_traces(traces, *args, **conditions)
    size, page = min(500, max(1, size)), max(1, page)
    return kept.orderBy(F.desc("start_time"), "trace_id").offset((page - 1) * size).limit(size).select(*_LISTED, has_error().alias("has_error"))


def trace_page(kept: DataFrame, size: int = 50, after: tuple[datetime, int] | None = None) -> DataFrame:
    """The first traces of kept, newest first, behind the trace `after` (start_time, trace_id),
    with how many there are in all (total) and what to give as `after` for the next page
    (next_start_time, next_trace_id; NULL on the last one). Rows and total come from one scan,
    and a page costs the same wherever it is. At most 500 rows, all that passes the driver.
    A trace without a start_time is counted and on no page."""
    size, seen = min(500, max(1, size)), Observation()
    rows = kept.observe(seen, F.count(F.lit(1)).alias("total")).where("start_time is not null")
    if after is not None:
        at = F.lit(after[0]).cast("timestamp_ntz")
        rows = rows.where((F.col("start_time") < at) | ((F.col("start_time") == at) & (F.col("trace_id") > after[1])))
    found = rows.orderBy(F.desc("start_time"), "trace_id").limit(size + 1).select(*_LISTED, has_error().alias("has_error"))
    got = found.collect()
    total, page = seen.get["total"], got[:size]
    last = page[-1] if len(got) > size else None
    more = [(total, last and last["start_time"], last and last["trace_id"])] * len(page)
    schema = StructType([*found.schema.fields, StructField("total", LongType()), StructField("next_start_time", found.schema["start_time"].dataType), StructField("next_trace_id", found.schema["trace_id"].dataType)])
    return kept.sparkSession.createDataFrame([tuple(r) + m for r, m in zip(page, more)], schema)


def trace_detail(traces: DataFrame, calls: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Traces with their calls in order, and their documents by rank, as arrays."""
    g = calls.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "call_no", "model", "input_tokens", "output_tokens"))).alias("calls"))
    out = traces.join(g, "trace_id", "left")
    if documents is None:
        return out
    d = documents.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("rank", "document_id", "title", "final_score"))).alias("documents"))
    return out.join(d, "trace_id", "left")


def agent_loop(spans: DataFrame, window: int = 3) -> DataFrame:
    """Whether the latest step occurs twice or more among a session's last steps."""
    w = Window.partitionBy("session_id").orderBy("start_time", "span_id").rowsBetween(1 - window, 0)
    same = F.size(F.filter(F.collect_list("kind").over(w), lambda k: k == F.col("kind")))
    return spans.select("span_id", "session_id", (same >= 2).alias("looping"))
