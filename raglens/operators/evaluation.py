"""Answer evaluation, run comparison, experiments and recommendation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raglens.functions.scalars import citation_markers, claims, content_words, coverage, shared_cosine

#: Directions of metrics; others are neutral.
HIGHER_IS_BETTER = """
precision_at_k recall_at_k f1_at_k mrr ndcg_at_k hit_rate_at_k precision recall f1 rr reciprocal_rank ndcg hit_rate
faithfulness answer_relevance context_relevance citation_coverage quality_score token_efficiency retrieval_score
""".split()
LOWER_IS_BETTER = """
estimated_cost avg_cost_per_1k_tokens avg_latency_ms duration_ms avg_tokens_per_request cost_per_1k_tokens cost_per_request
cost_per_user cost_per_application total_cost p50_latency_ms p95_latency_ms p99_latency_ms max_latency_ms p95_duration_ms
unsupported_claim_ratio zero_result_rate error_rate duplicate_ratio potential_waste_pct wasted_tokens
""".split()
#: Overlap that settles a claim, and overlap or similarity that supports it.
SETTLES, SUPPORTS, SIMILAR = 0.8, 0.5, 0.55


def grounding(answer: Column, context: Column, similarity: Column | None = None) -> Column:
    """struct(claims, supported, score) of an answer. Over the sentences of the context, in
    their order, the first that covers a claim's content words by SETTLES ends the search with
    its overlap and similarity; else a greater similarity replaces both and a greater overlap
    the overlap. similarity: array (claim, then sentence) of cosines, if texts were embedded.
    A claim without content words is covered by nothing. No claims score 1.0."""
    said = claims(answer)
    sentences = F.filter(F.flatten(F.transform(context, lambda c: F.transform(claims(c), content_words))), lambda w: F.size(w) > 0)
    state = lambda done, sim, over: F.struct(done.alias("done"), sim.alias("sim"), over.alias("over"))

    def best(words: Column, sims: Column | None, known: Column) -> Column:
        over = lambda w, x: F.struct(coverage(words, w).alias("over"), F.coalesce(x.cast("double"), F.lit(0.0)).alias("sim"))

        def step(acc: Column, x: Column) -> Column:
            return (
                F.when(acc["done"], acc)
                .when(x["over"] >= SETTLES, state(F.lit(True), x["sim"], x["over"]))
                .when(x["sim"] > acc["sim"], state(F.lit(False), x["sim"], x["over"]))
                .otherwise(state(F.lit(False), acc["sim"], F.greatest(acc["over"], x["over"])))
            )

        pairs = F.transform(known, lambda w: over(w, F.lit(0.0))) if sims is None else F.zip_with(known, sims, over)
        return F.aggregate(pairs, state(F.lit(False), F.lit(0.0), F.lit(0.0)), step)

    # an array of one: the words of claims and sentences are cut once, not again for each pair
    held = F.array(F.struct(F.transform(said, content_words).alias("said"), sentences.alias("known")))
    each = lambda h: F.transform(h["said"], lambda words, at: best(words, F.get(similarity, at) if similarity is not None else None, h["known"]))
    found = F.get(F.transform(held, each), F.lit(0))
    n, ok = F.size(said), F.size(F.filter(found, lambda x: (x["sim"] >= SIMILAR) | (x["over"] >= SUPPORTS)))
    return F.struct(n.alias("claims"), ok.alias("supported"), F.when(n == 0, 1.0).otherwise(ok / n).alias("score"))


def citation_coverage(answer: Column, documents: Column) -> Column:
    """Share of citation markers that name one of the documents - an array of struct(id, title,
    source) - by id, place from 1, title or source; 0.0 without any marker."""
    tidy = lambda x: F.lower(F.trim(x))
    known = F.flatten(F.transform(documents, lambda d, i: F.array(tidy(d["id"]), (i + 1).cast("string"), tidy(d["title"]), tidy(d["source"]))))
    known = F.filter(known, lambda x: x.isNotNull() & (x != ""))
    found = citation_markers(answer)
    return F.when(F.size(found) == 0, 0.0).otherwise(F.size(F.filter(found, lambda m: F.array_contains(known, m))) / F.size(found))


def answer_scores(rows: DataFrame) -> DataFrame:
    """rows with context_relevance (mean cosine of question and passages), answer_relevance
    (0.7 of the cosine of question and answer, 0.3 of the question's content words that the
    answer has); NULL where a vector is missing. rows: question, answer, question_vector,
    answer_vector, context_vectors."""
    q = F.col("question_vector")
    near = F.transform("context_vectors", lambda v: shared_cosine(q, v))
    mean_near = F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda s, x: s + x) / F.size(near))
    said = coverage(content_words(F.col("question")), content_words(F.col("answer")))
    return rows.withColumns({"context_relevance": clamp_or_null(mean_near), "answer_relevance": clamp_or_null(0.7 * shared_cosine(q, F.col("answer_vector")) + 0.3 * said)})


def clamp_or_null(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def answer_eval_summary(rows: DataFrame) -> DataFrame:
    """One row: number of answers, of judged ones, and the means of what was measured."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return rows.agg(F.count("*").alias("answers"), F.count("faithfulness").alias("judged"), mean("faithfulness"), mean("answer_relevance"))


def metric_deltas(baseline: DataFrame, candidate: DataFrame, threshold_pct: float = 5.0) -> DataFrame:
    """metric, baseline, candidate, change, change_pct, is_regression of the metrics that both
    runs (metric, value) have."""
    b, c = baseline.select("metric", F.col("value").alias("baseline")), candidate.select("metric", F.col("value").alias("candidate"))
    d = b.join(c, "metric").withColumn("change", F.col("candidate") - F.col("baseline"))
    d = d.withColumn("change_pct", F.when(F.col("baseline") == 0, 0.0).otherwise(F.col("change") / F.abs("baseline") * 100))
    up, down = F.col("metric").isin(*HIGHER_IS_BETTER), F.col("metric").isin(*LOWER_IS_BETTER)
    worse = F.when(F.col("baseline") == 0, up & (F.col("change") < -1e-9)).otherwise((up & (F.col("change_pct") < -(threshold_pct - 1e-9))) | (down & (F.col("change_pct") > threshold_pct - 1e-9)))
    return d.select("metric", "baseline", "candidate", F.round("change", 9).alias("change"), F.round("change_pct", 6).alias("change_pct"), worse.alias("is_regression"))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys that both configurations (key, value) have with different values."""
    return a.select("key", F.col("value").alias("old")).join(b.select("key", F.col("value").alias("new")), "key").where(~F.col("old").eqNullSafe(F.col("new")))


def flat_config(runs: DataFrame, config: str = "config") -> DataFrame:
    """run_id, key, value of a JSON object; an object within it gives keys outer.inner."""
    outer = F.from_json(config, "map<string,string>")
    rows = runs.select("run_id", F.explode(outer).alias("key", "value"))
    inner = F.when(F.col("value").startswith("{"), F.from_json("value", "map<string,string>"))
    each = F.when(inner.isNotNull(), F.transform(F.map_entries(inner), lambda e: F.struct(F.concat_ws(".", "key", e["key"]).alias("key"), e["value"].alias("value")))).otherwise(F.array(F.struct("key", "value")))
    return rows.select("run_id", F.explode(each).alias("x")).select("run_id", "x.*")


def delta_sentences(deltas: DataFrame) -> DataFrame:
    """metric, sentence of the rows of metric_deltas()."""
    word = F.when(F.col("change") > 0, "rose").when(F.col("change") < 0, "fell").otherwise("stayed")
    number = lambda c: F.regexp_replace(F.format_string("%.6f", F.col(c)), r"\.?0+$", "")
    flag = F.when(F.col("is_regression"), " (regression)").otherwise("")
    return deltas.select("metric", F.concat(F.col("metric"), F.lit(" "), word, F.lit(" from "), number("baseline"), F.lit(" to "), number("candidate"), flag).alias("sentence"))


def regressions(deltas: DataFrame) -> DataFrame:
    return deltas.where("is_regression")


def comparable(runs: DataFrame) -> DataFrame:
    """baseline_id, candidate_id of the pairs of different runs (run_id, dataset) over one dataset."""
    b = runs.select(F.col("run_id").alias("candidate_id"), F.col("dataset").alias("_d"))
    return runs.join(b, (F.col("dataset") == F.col("_d")) & (F.col("run_id") < F.col("candidate_id"))).select(F.col("run_id").alias("baseline_id"), "candidate_id")


def experiment_deltas(variants: DataFrame, metrics: DataFrame) -> DataFrame:
    """Changes of each arm against the baseline arm. variants: experiment, variant, run_id,
    is_baseline; metrics: run_id, metric, value. An arm whose run is missing has no metrics."""
    m = variants.join(metrics, "run_id", "left")
    base = m.where("is_baseline and metric is not null").select(F.col("experiment").alias("_e"), F.col("metric").alias("_m"), F.col("value").alias("baseline"))
    arms = m.where("not is_baseline")
    joined = arms.join(base, (F.col("experiment") == F.col("_e")) & (F.col("metric") == F.col("_m")), "left")
    change = F.col("value") - F.col("baseline")
    return joined.select("experiment", "variant", "metric", F.col("value").alias("candidate"), "baseline", F.round(change, 9).alias("change"), F.round(F.when(F.col("baseline") == 0, 0.0).otherwise(change / F.abs("baseline") * 100), 6).alias("change_pct"))


def priority(severity: Column) -> Column:
    return F.when(severity >= 0.5, "high").when(severity >= 0.2, "medium").otherwise("low")


def confidence(n: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + n / 2000.0)


def rule(name: str, facts: DataFrame, value: Column, samples: Column, severity: Column, fires: Column, least: int = 30) -> DataFrame:
    """One row: whether a rule has its evidence. facts: one row."""
    v = facts.select(F.round(value, 6).alias("value"), samples.cast("long").alias("samples"), F.round(severity, 6).alias("severity"), F.coalesce(fires & (samples >= least), F.lit(False)).alias("fires"))
    return v.select(F.lit(name).alias("rule"), "value", "samples", "fires", F.when(F.col("fires"), priority(F.col("severity"))).alias("priority"), F.when(F.col("fires"), F.round(confidence(F.col("samples")), 6)).alias("confidence"))


def rule_latency_tail(latency: DataFrame) -> DataFrame:
    """latency: p50, p95, n."""
    r = F.col("p95") / F.col("p50")
    return rule("latency_tail", latency, r, F.col("n"), (r - 3) / 3, r >= 3)


def rule_error_rate(summary: DataFrame) -> DataFrame:
    """summary: traces, errors."""
    r = F.col("errors") / F.col("traces")
    return rule("error_rate", summary, r, F.col("traces"), F.least(F.lit(1.0), 5 * r), r >= 0.02)


def rule_repeated_prefix(texts: DataFrame, length: int = 200) -> DataFrame:
    """texts: text. Share of the most frequent prefix (the first by order on ties)."""
    g = texts.where("text is not null").groupBy(F.left("text", F.lit(length)).alias("prefix")).agg(F.count("*").alias("n"))
    facts = g.agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    r = F.col("top") / F.col("n")
    return rule("repeated_prefix", facts, r, F.col("n"), r, r >= 0.20)


def rule_duplicate_context(ratios: DataFrame) -> DataFrame:
    """ratios: duplicate_ratio per call."""
    facts = ratios.agg(F.avg("duplicate_ratio").alias("r"), F.count("duplicate_ratio").alias("n"))
    return rule("duplicate_context", facts, F.col("r"), F.col("n"), F.col("r"), F.col("r") >= 0.05)


def rule_unused_context(use: DataFrame) -> DataFrame:
    """use: unused_share, context_tokens per call."""
    facts = use.agg(F.avg("unused_share").alias("r"), F.avg("context_tokens").alias("c"), F.count("unused_share").alias("n"))
    return rule("unused_context", facts, F.col("r"), F.col("n"), F.col("r"), (F.col("r") >= 0.60) & (F.col("c") >= 500))


def rule_small_model(calls: DataFrame, models: DataFrame) -> DataFrame:
    """Mean input of the used model with the smallest registered context window, against that
    window. Models are met by name; ties go to the first name."""
    windows = models.where("context_window is not null").select(F.col("name").alias("_n"), "context_window")
    g = calls.where("input_tokens is not null").groupBy("model").agg(F.sum("input_tokens").alias("s"), F.count("*").alias("n"))
    # a name that several providers register meets each of them, as a join of the calls would
    used = g.join(windows, g.model == windows["_n"]).groupBy("model").agg(F.min("context_window").alias("context_window"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    facts = used.agg(F.min_by(F.struct("context_window", (F.col("s") / F.col("n")).alias("mean"), "n"), F.struct("context_window", "model")).alias("x")).select("x.*")
    r = F.col("mean") / F.col("context_window")
    return rule("small_model", facts, r, F.col("n"), r, (F.col("mean") >= 512) & (r >= 0.5))


def context_citation(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: unused_share and samples of all documents (trace_id, content) whose trace has an
    answer (trace_id, answer): the share of their characters in documents of which the answer
    has less than half of the long words."""
    long = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: F.length(w) > 3))
    d = documents.where("content <> ''").join(answers.where("answer <> ''"), "trace_id").select(F.length("content").alias("chars"), long("content").alias("w"), long("answer").alias("a"))
    used = (F.size("w") > 0) & (F.size(F.array_intersect("w", "a")) / F.size("w") >= 0.5)
    g = d.agg(F.sum("chars").alias("all"), F.sum(F.when(used, F.col("chars"))).alias("used"), F.count("*").alias("samples"))
    return g.select((1 - F.coalesce("used", F.lit(0)) / F.when(F.col("all") > 0, F.col("all"))).alias("unused_share"), "samples")


def rule_context_citation(citation: DataFrame, mean_context: DataFrame) -> DataFrame:
    """citation: context_citation(); mean_context: one row, context_tokens."""
    facts = citation.join(F.broadcast(mean_context))  # one row each
    r = F.col("unused_share")
    return rule("unused_context", facts, r, F.col("samples"), r, (r >= 0.60) & (F.coalesce("context_tokens", F.lit(0.0)) >= 500))


def every_rule(rules: list[DataFrame]) -> DataFrame:
    """All rules' rows, which are one each."""
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out
