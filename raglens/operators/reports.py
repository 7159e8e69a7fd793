"""Composite reports: several aggregates of one window as rows (section, key, metric, value).
A measure that doesn't exist is NULL. The large reports write the columns that they need of the
calls, or traces, once, group them in all ways at once (shared.py) and delete them again, when
the report's own few rows are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raglens.functions.scalars import cost_label, ratio, window_label
from raglens.operators import analytics as an
from raglens.operators import shared
from raglens.operators.shared import Groups, Section
from raglens.sources.shared import settled, written

CALL_CARDS = ["calls", "errors", "input_tokens", "output_tokens", "total_tokens", "cost", "p95_latency_ms"]
TRACE_CARDS = ["traces", "errors", "users", "error_rate", "p95_duration_ms"]
TOKEN_CARDS = ["input_tokens", "output_tokens", "total_tokens", "max_tokens", "p50_tokens", "p95_tokens", "p99_tokens"]
LATENCY_CARDS = ["avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms"]
DURATION_CARDS = ["avg_duration_ms", "p50_duration_ms", "p95_duration_ms", "p99_duration_ms", "max_duration_ms"]
UNIT_CARDS = ["total_cost", "cost_per_request", "cost_per_user", "cost_per_application"]
EFFICIENCY_CARDS = ["scored", "avg_score", "avg_duplicate_ratio", "avg_context_share", "avg_output_yield", "avg_potential_waste_pct", "avg_wasted_tokens"]
MODELS = 100


def section(rows: DataFrame, name: str, metrics: list[str], key: Column | None = None) -> DataFrame:
    """The metrics of rows, one row each. key: what names a row, '' for the only one."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    k = F.lit("") if key is None else key.cast("string")
    return rows.select(F.lit(name).alias("section"), k.alias("key"), F.explode(each).alias("x")).select("section", "key", "x.*")


def report(*sections: DataFrame) -> DataFrame:
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def per_unit(summary: DataFrame, traces: DataFrame) -> DataFrame:
    """Cost in all, and for each request, user and application with traffic; 0.0 where there is
    none of these. summary: call_summary(); traces: the window's traces."""
    n = traces.agg(F.count("*").alias("_t"), F.countDistinct("user_id").alias("_u"), F.countDistinct("application_id").alias("_a"))
    x = summary.select("cost").join(F.broadcast(n))  # one row each
    each = lambda c: ratio(F.col("cost"), F.col(c))
    return x.select(F.col("cost").alias("total_cost"), *(F.round(each(c), 8).alias(m) for c, m in (("_t", "cost_per_request"), ("_u", "cost_per_user"), ("_a", "cost_per_application"))))


def cost_provenance(calls: DataFrame, models: DataFrame) -> DataFrame:
    """One row: the label of the window's costs out of those of its models."""
    used = calls.select("provider", "model").distinct()
    m = models.select(F.col("provider").alias("_p"), F.col("name").alias("_n"), "is_local")
    x = used.join(m, (F.col("provider") == F.col("_p")) & (F.col("model") == F.col("_n")), "left")
    return x.agg(F.array_sort(F.collect_set(cost_label(F.col("is_local").isNotNull(), F.col("is_local")))).alias("_l")).select(window_label(F.col("_l")).alias("label"))


def efficiency_findings(rollup: DataFrame) -> DataFrame:
    """Sentences about a token_efficiency_rollup(); one that says so if nothing was scored."""
    say = lambda text, *cs: F.format_string(text, *(F.col(c) for c in cs))
    some = F.array(say("%d traces were scored, %.2f on average.", "scored", "avg_score"), say("%.2f per cent of input tokens brought no output.", "avg_potential_waste_pct"), F.when(F.col("avg_duplicate_ratio") > 0, say("%.4f of the retrieved documents were duplicates.", "avg_duplicate_ratio")))
    return rollup.select(F.explode(F.when(F.col("scored") == 0, F.array(F.lit("Not analysed: no trace was scored."))).otherwise(F.array_compact(some))).alias("finding"))


def _narrow(calls: DataFrame) -> DataFrame:
    """What reports read of calls, written once."""
    return written(calls.select("trace_id", "created_at", "model", "provider", "input_tokens", "output_tokens", "latency_ms", "cost", "status"), "calls")


def _with_buckets(scope: an.Scope, rows: DataFrame, ts: str) -> DataFrame:
    return rows.withColumn("bucket", F.when(scope.holds(ts), an.bucket(ts, scope.unit)))


def _calls(scope: an.Scope, narrow: DataFrame, series: bool, shares: dict[str, float] | None = None, value: str = "latency_ms", of: tuple[str, ...] = ("all",), models: int = MODELS) -> Groups:
    """The window's calls as a whole, by model (the first ones by tokens) and by bucket."""
    sets: dict[str, tuple[str, ...]] = {"all": (), "model": ("provider", "model")} | ({"bucket": ("bucket",)} if series else {})
    both = F.col("input_tokens") + F.col("output_tokens")
    more = {"max_latency_ms": F.coalesce(F.max("latency_ms"), F.lit(0.0)), "tokens_per_call": F.round(F.try_divide(F.sum(both), F.count("*")), 6)}
    rows = _with_buckets(scope, scope.rows(narrow, "created_at"), "created_at").withColumn("_both", both)
    g = shared.grouped(rows, sets, an.call_measures() | more, shares, value, of)
    g = Groups(g.rows.withColumn("tokens", F.col("total_tokens")), g.keys)
    return shared.kept(g, "model", [F.desc("total_tokens"), F.col("model"), F.col("provider")], models)


def _named(groups: Groups, applications: DataFrame) -> Groups:
    """With the applications' names; groups of unknown applications are left out."""
    a = applications.select(F.col("id").alias("_a"), "name")
    return Groups(groups.rows.join(a, F.col("application_id") == F.col("_a"), "left").where("grouping <> 'application' or _a is not null").drop("_a"), groups.keys)


def _pair() -> Column:
    return F.concat_ws("/", "provider", "model")


def dashboard(scope: an.Scope, calls: DataFrame, traces: DataFrame, documents: DataFrame, answers: DataFrame, anomalies: DataFrame, recommendations: DataFrame, applications: DataFrame) -> DataFrame:
    """Cards, models, applications and series of a window; token efficiency, retrieval and
    answer scores, and what isn't settled, of all times. Calls, traces, documents and answers are
    read once each: what concerns traces is grouped out of one row per trace."""
    spark, day = traces.sparkSession, F.to_date("bucket")
    narrow = _narrow(calls)
    c = _calls(scope, narrow, True, {"p95_latency_ms": 0.95})
    sums = narrow.groupBy("trace_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))
    used = sums.join(an.document_facts(documents).withColumnRenamed("created_at", "retrieved_at"), "trace_id", "full")
    used = used.withColumn("_e", an.efficiency())
    owned = traces.select("trace_id", "application_id", "user_id", "start_time", "duration_ms", an.has_error().alias("bad"))
    rows = owned.withColumn("_in", scope.holds("start_time")).join(used, "trace_id", "full")
    inside = F.coalesce(F.col("_in"), F.lit(False))
    rows = rows.select(
        "top_score",
        "_e.*",
        *(F.when(inside, F.col(x)).alias(x) for x in ("application_id", "user_id", "duration_ms", "bad")),
        *(F.when(inside, F.coalesce(F.col(x), F.lit(0))).alias(x) for x in ("input_tokens", "output_tokens", "cost")),
        F.when(inside, an.bucket("start_time", scope.unit)).alias("bucket"),
        F.when(scope.holds("retrieved_at"), an.bucket("retrieved_at", scope.unit)).alias("retrieval_bucket"),
        inside.alias("inside"),
    )
    rows = written(rows, "traces")
    n, bad = F.count_if("inside"), F.count_if("bad")
    measures = {"traces": n, "errors": bad, "users": F.countDistinct("user_id"), "error_rate": ratio(bad.cast("double"), n), "tokens": F.sum(F.col("input_tokens") + F.col("output_tokens")), "cost": F.sum("cost").cast("double"), "retrieval_score": an.mean("top_score")}
    sets = {"all": (), "application": ("application_id",), "bucket": ("bucket",), "retrieved": ("retrieval_bucket",)}
    x = shared.grouped(rows, sets, measures | an.efficiency_means(), {"p95_duration_ms": 0.95}, "duration_ms", ("all",))
    x = _named(x, applications)
    a = shared.grouped(_with_buckets(scope, answers, "created_at"), {"all": (), "bucket": ("bucket",)}, {m: an.mean(m) for m in ("faithfulness", "answer_relevance")})
    series = ["calls", "tokens", "cost", "traces", "retrieval_score", "faithfulness"]
    out = shared.report(
        shared.sections(c, Section("calls", "all", CALL_CARDS), Section("models", "model", ["calls", "tokens", "cost", "errors"], _pair()), Section("series", "bucket", series[:3], day)),
        shared.sections(
            x,
            Section("traces", "all", TRACE_CARDS),
            Section("retrieval", "all", ["retrieval_score"]),
            Section("efficiency", "all", EFFICIENCY_CARDS),
            Section("applications", "application", ["traces", "errors", "users", "tokens", "cost"], F.col("name")),
            Section("series", "bucket", ["traces"], day),
            Section("series", "retrieved", ["retrieval_score"], F.to_date("retrieval_bucket")),
        ),
        shared.sections(a, Section("answers", "all", ["faithfulness", "answer_relevance"]), Section("series", "bucket", ["faithfulness"], day)),
        shared.skeleton(an.bucket_series(spark, scope), "series", day, series),
    )
    out = report(out, section(an.open_insights(anomalies, recommendations), "open", ["open_anomalies", "open_recommendations"]))
    return settled(out, narrow, rows)


def tokens(scope: an.Scope, calls: DataFrame, traces: DataFrame, applications: DataFrame, users: int = 50) -> DataFrame:
    """Tokens of a window: cards, and users (the first ones), applications and models by tokens."""
    narrow = _narrow(calls)
    c = _calls(scope, narrow, False, {f"p{p}_tokens": p / 100 for p in (50, 95, 99)}, "_both")
    rows = an.trace_totals(scope.rows(traces, "start_time").select("trace_id", "application_id", "user_id"), narrow)
    rows = rows.withColumn("user", F.coalesce(F.col("user_id").cast("string"), F.lit("(anonymous)")))
    measures = {"tokens": F.sum("total_tokens"), "cost": F.sum("cost").cast("double"), "traces": F.count("*")}
    x = shared.grouped(rows, {"user": ("user",), "application": ("application_id",)}, measures)
    x = _named(shared.kept(x, "user", [F.desc("tokens"), F.col("user")], users), applications)
    out = shared.report(
        shared.sections(c, Section("tokens", "all", TOKEN_CARDS), Section("mean", "all", ["tokens_per_call"]), Section("models", "model", ["tokens", "cost", "calls"], _pair())),
        shared.sections(x, Section("users", "user", ["tokens", "cost", "traces"], F.col("user")), Section("applications", "application", ["tokens", "cost", "traces"], F.col("name"))),
    )
    return settled(out, narrow)


def latency(scope: an.Scope, calls: DataFrame, traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Latency of a window's calls and models and duration of its traces, side by side, with the
    series; kinds of spans of all times."""
    spark, day = traces.sparkSession, F.to_date("bucket")
    narrow = _narrow(calls)
    c = _calls(scope, narrow, False, {f"p{p}_latency_ms": p / 100 for p in (50, 95, 99)}, of=("all", "model"))
    rows = _with_buckets(scope, scope.rows(traces, "start_time"), "start_time").select("bucket", "duration_ms")
    rows = written(rows, "traces")
    measures = {"avg_duration_ms": an.exact_mean("duration_ms"), "max_duration_ms": F.max("duration_ms")}
    x = shared.grouped(rows, {"all": (), "bucket": ("bucket",)}, measures, {f"p{p}_duration_ms": p / 100 for p in (50, 95, 99)}, "duration_ms", ("all",))
    k = shared.grouped(spans.select("kind", "duration_ms"), {"kind": ("kind",)}, {"spans": F.count("*"), "avg_ms": an.mean("duration_ms")}, {"p95_ms": 0.95}, "duration_ms", ("kind",))
    out = shared.report(
        shared.sections(c, Section("calls", "all", LATENCY_CARDS), Section("max", "all", ["max_latency_ms"]), Section("models", "model", ["calls", "p95_latency_ms"], _pair())),
        shared.sections(x, Section("traces", "all", DURATION_CARDS), Section("series", "bucket", ["avg_duration_ms"], day)),
        shared.sections(k, Section("stages", "kind", ["spans", "avg_ms", "p95_ms"], F.col("kind"))),
        shared.skeleton(an.bucket_series(spark, scope), "series", day, ["avg_duration_ms"]),
    )
    return settled(out, narrow, rows)


def costs(scope: an.Scope, calls: DataFrame, traces: DataFrame) -> DataFrame:
    """Cost of a window, in all and per unit, by model and as a series."""
    spark, day = traces.sparkSession, F.to_date("bucket")
    narrow = _narrow(calls)
    c = _calls(scope, narrow, True)
    total = scope.rows(narrow, "created_at").agg(F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)).alias("cost"))
    out = shared.report(shared.sections(c, Section("models", "model", ["cost", "calls"], _pair()), Section("series", "bucket", ["cost"], day)), shared.skeleton(an.bucket_series(spark, scope), "series", day, ["cost"]))
    return settled(report(section(per_unit(total, scope.rows(traces, "start_time")), "cost", UNIT_CARDS), out), narrow)


def efficiency(calls: DataFrame, documents: DataFrame, traces: DataFrame, applications: DataFrame) -> DataFrame:
    """Token efficiency of all traces, the most wasteful ones, and applications by waste. The
    analysis of the traces is written once."""
    a = written(an.trace_analysis(calls, documents), "analysis")
    out = report(
        section(an.token_efficiency_rollup(a), "rollup", EFFICIENCY_CARDS),
        section(an.wasteful_traces(a), "offenders", ["wasted_tokens", "score"], F.col("trace_id")),
        section(an.waste_by_application(a, traces, applications), "applications", ["traces", "avg_waste_pct", "wasted_tokens"], F.col("name")),
        section(calls.agg(F.sum("input_tokens").alias("input_tokens")), "input", ["input_tokens"]),
    )
    return settled(out, a)
