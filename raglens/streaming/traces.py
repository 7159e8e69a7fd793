"""Ingest of nested trace payloads: a payload frame becomes the tables traces, spans,
retrievals, documents and generations, as a batch or in each micro-batch of a stream.

A payload names its trace by (application, trace_id). The fields that it sends, and only
these, replace the stored ones; metadata is merged, keys that the engine owns are dropped from
it; the kind is set once. Children that a payload sends replace all of their sort, others
stay. A replay changes nothing. Payloads without application or trace_id, or with a negative
duration, are dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raglens.functions.scalars import call_cost, document_text, estimate_tokens, settled
from raglens.operators.analytics import duplicate_documents
from raglens.streaming.log import KeyedLog

SPAN = "struct<span_id:string,name:string,kind:string,start_time:timestamp_ntz,end_time:timestamp_ntz,duration_ms:double,status:string,error:string>"
DOCUMENT = "struct<document_id:string,title:string,rank:int,final_score:double,content:string,content_preview:string>"
RETRIEVAL = f"struct<query:string,retriever:string,top_k:int,timestamp:timestamp_ntz,duration_ms:double,documents:array<{DOCUMENT}>>"
GENERATION = "struct<model:string,provider:string,prompt:string,completion:string,input_tokens:long,output_tokens:long,duration_ms:double,status:string,span_id:string,timestamp:timestamp_ntz>"
#: A payload; `seq` orders payloads of one trace, `sent` names the fields that it has.
PAYLOAD = (
    "seq long, sent array<string>, application string, trace_id string, user_id string, session_id string, kind string, name string, start_time timestamp_ntz, end_time timestamp_ntz, duration_ms double, "
    "input_text string, output_text string, error string, status string, context_tokens long, metadata map<string,string>, "
    f"spans array<{SPAN}>, retrievals array<{RETRIEVAL}>, generations array<{GENERATION}>"
)
NAMES = [x.split(" ", 1)[0] for x in PAYLOAD.split(", ")]
KEY = ["application", "trace_id"]
#: Fields that a later payload may replace.
FIELDS = ["user_id", "session_id", "name", "start_time", "end_time", "duration_ms", "input_text", "output_text", "error", "status", "context_tokens"]
#: Metadata keys that only the engine writes.
OWNED = ("token_efficiency", "retrieval_analysis")
#: Hits of a question that rag_payloads() takes, and characters of a preview.
MOST_DOCUMENTS, PREVIEW = 100, 2000


def parsed(lines: DataFrame, column: str = "value", seq: str = "seq") -> DataFrame:
    """Payloads of JSON lines; a line that isn't an object gives one without a key."""
    body = ", ".join(x for x in PAYLOAD.split(", ") if not x.startswith(("seq ", "sent ")))
    j = F.from_json(column, body)
    return lines.select(F.col(seq).cast("long").alias("seq"), F.json_object_keys(column).alias("sent"), j.alias("j")).select("seq", "sent", "j.*")


def fault() -> Column:
    """Why a payload can't be taken; NULL if it can."""
    return (
        F.when(F.coalesce(F.size("sent"), F.lit(-1)) < 0, "not a JSON object")
        .when(F.coalesce(F.col("application"), F.lit("")) == "", "no application")
        .when(F.coalesce(F.col("trace_id"), F.lit("")) == "", "no trace_id")
        .when(F.coalesce("duration_ms", F.lit(0.0)) < 0, "negative duration_ms")
    )


def good() -> Column:
    return F.coalesce((F.col("application") != "") & (F.col("trace_id") != "") & (F.coalesce("duration_ms", F.lit(0.0)) >= 0), F.lit(False))


def dead_letters(payloads: DataFrame) -> DataFrame:
    """The payloads that can't be taken, and why (error)."""
    return payloads.where(~good()).withColumn("error", F.coalesce(fault(), F.lit("not a JSON object")))


def _sent(name: str) -> Column:
    return F.array_contains("sent", name)


KIDS = ["spans", "retrievals", "generations"]


def states(payloads: DataFrame) -> DataFrame:
    """What each payload says of its trace: every field, every entry of the metadata and every
    sort of children with the number of the payload that sent it, NULL where it sent none."""
    dated = lambda c: F.when(_sent(c), F.struct("seq", F.col(c).alias("v"))).alias(c)
    ours = F.map_filter("metadata", lambda k, _: ~k.isin(*OWNED))
    return payloads.where(good()).select(
        *KEY,
        "seq",
        *(dated(c) for c in FIELDS),
        F.when(F.col("kind").isNotNull(), F.struct("seq", F.col("kind").alias("v"))).alias("kind"),
        F.when(_sent("metadata"), F.transform_values(ours, lambda _, v: F.struct(F.col("seq").alias("seq"), v.alias("v")))).alias("metadata"),
        *(dated(c) for c in KIDS),
    )


def joined(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One state for each trace: of everything what was sent last, and the first kind. States of
    states, in any order and repeated, give the same. The rows are sorted once and each trace is
    a window: nested states aren't aggregated twice, before and after their shuffle."""
    w = Window.partitionBy(*key).orderBy("seq")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    said = {f"_{c}": F.max(c).over(every) for c in ("seq", *FIELDS, *KIDS)}
    entries = F.array_sort(F.flatten(F.collect_list(F.map_entries("metadata")).over(every)))
    g = rows.withColumns(said | {"_kind": F.min("kind").over(every), "_m": entries, "_n": F.row_number().over(w)}).where("_n = 1")
    # sorted by key and number: the last entry of each key stays
    last = F.filter("_m", lambda e, i: ~F.coalesce(F.get("_m", i + 1)["key"] == e["key"], F.lit(False)))
    g = g.withColumn("_metadata", F.map_from_entries(last))
    return g.select(*(c if c in key else F.col(f"_{c}").alias(c) for c in rows.columns))


def shown(rows: DataFrame) -> DataFrame:
    """Merged payloads of states: one row for each trace."""
    plain = [F.col(c)["v"].alias(c) for c in [*FIELDS, "kind", *KIDS]]
    has = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in [*FIELDS, "kind", *KIDS]] + [F.when(F.size("metadata") > 0, F.lit("metadata"))]
    out = rows.select(*KEY, "seq", *plain, F.transform_values("metadata", lambda _, v: v["v"]).alias("metadata"), F.array_compact(F.array(*has)).alias("sent"))
    time = settled(F.col("start_time"), F.col("end_time"), F.col("duration_ms"), F.coalesce("status", F.lit("running")))
    return out.withColumns({"end_time": time["end_time"], "duration_ms": time["duration_ms"]}).select(*NAMES)


def merged(payloads: DataFrame) -> DataFrame:
    """One row for each trace: of every field the value that was sent last, the first kind, the
    union of the metadata, and the children sent last."""
    return shown(joined(states(payloads)))


def children(traces: DataFrame, prices: DataFrame) -> dict[str, DataFrame]:
    """The child tables of merged payloads, with all documents of a retrieval. prices: provider,
    name, input_cost_per_1k, output_cost_per_1k, is_local."""
    spans = traces.select(*KEY, F.posexplode("spans").alias("span_no", "x")).select(*KEY, "span_no", "x.*")
    time = settled(F.col("start_time"), F.col("end_time"), F.col("duration_ms"), F.coalesce("status", F.lit("success")))
    spans = spans.withColumns({"end_time": time["end_time"], "duration_ms": time["duration_ms"]})
    calls = traces.select(*KEY, F.posexplode("retrievals").alias("retrieval_no", "x")).select(*KEY, "retrieval_no", "x.*")
    docs = calls.select(*KEY, "retrieval_no", F.posexplode("documents").alias("place", "d")).select(*KEY, "retrieval_no", "place", "d.*")
    short = F.left(F.col("content"), F.lit(PREVIEW))
    docs = docs.withColumns(
        {
            "rank": F.coalesce("rank", F.col("place") + 1),
            "content_preview": F.coalesce("content_preview", F.when(short != "", short)),
            "tokens": estimate_tokens(document_text(F.col("content"), F.col("content_preview"))),
        }
    ).drop("place")
    facts = docs.groupBy(*KEY, "retrieval_no").agg(F.count("*").alias("num_results"), F.sum("tokens").alias("context_tokens"), F.max("final_score").alias("top_score"))
    zero = F.lit(0).cast("long")
    calls = calls.drop("documents").join(facts, [*KEY, "retrieval_no"], "left").withColumns({"num_results": F.coalesce("num_results", zero), "context_tokens": F.coalesce("context_tokens", zero)})
    gens = traces.select(*KEY, F.col("spans.span_id").alias("_own"), F.posexplode("generations").alias("call_no", "x")).select(*KEY, "_own", "call_no", "x.*")
    # a span id that isn't one of the trace's own is dropped
    gens = gens.withColumn("span_id", F.when(F.array_contains("_own", F.col("span_id")), F.col("span_id"))).drop("_own")
    derived = lambda given, text: F.greatest(zero, F.coalesce(given, estimate_tokens(F.coalesce(text, F.lit("")))))
    gens = gens.withColumns({"input_tokens": derived(F.col("input_tokens"), F.col("prompt")), "output_tokens": derived(F.col("output_tokens"), F.col("completion"))})
    m = prices.select(F.col("provider").alias("_p"), F.col("name").alias("_n"), "input_cost_per_1k", "output_cost_per_1k", "is_local")
    gens = gens.join(m, (F.col("provider") == F.col("_p")) & (F.col("model") == F.col("_n")), "left")
    gens = gens.withColumns({"total_tokens": F.col("input_tokens") + F.col("output_tokens"), "cost": call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_cost_per_1k"), F.col("output_cost_per_1k"), F.col("is_local"))})
    return {"spans": spans, "retrievals": calls, "documents": docs, "generations": gens.drop("_p", "_n", "input_cost_per_1k", "output_cost_per_1k", "is_local")}


def totals(traces: DataFrame, kids: dict[str, DataFrame]) -> DataFrame:
    """The traces, without their children, with sums of these: tokens and cost of the
    generations, context tokens and duplicates of the documents. Without retrievals the context
    tokens that were sent stay."""
    zero = F.lit(0).cast("long")
    g = kids["generations"].groupBy(*KEY).agg(*(F.sum(c).alias(f"_{c}") for c in ("input_tokens", "output_tokens", "cost")), F.count("*").alias("_calls"))
    d = kids["documents"].groupBy(*KEY).agg(F.sum("tokens").alias("_context"), F.count("*").alias("_documents"))
    call = kids["documents"].withColumn("content", document_text(F.col("content"), F.col("content_preview")))
    twice = duplicate_documents(call, (*KEY, "retrieval_no")).groupBy(*KEY).agg(F.countDistinct("document_id").alias("_twice"))
    out = traces.drop("spans", "retrievals", "generations", "sent").join(g, KEY, "left").join(d, KEY, "left").join(twice, KEY, "left")
    return out.withColumns(
        {
            "calls": F.coalesce("_calls", zero),
            "input_tokens": F.coalesce("_input_tokens", zero),
            "output_tokens": F.coalesce("_output_tokens", zero),
            "cost": F.coalesce("_cost", F.lit(0.0)),
            "context_tokens": F.coalesce("_context", "context_tokens", zero),
            "documents": F.coalesce("_documents", zero),
            "duplicates": F.coalesce("_twice", zero),
        }
    ).drop("_input_tokens", "_output_tokens", "_cost", "_calls", "_context", "_documents", "_twice")


def ingest(stored: DataFrame | None, payloads: DataFrame) -> DataFrame:
    """The payload log after a batch: what was stored and what is new, one merged payload for
    each trace. Reading it by children() and totals() gives the tables."""
    both = payloads.where(good()) if stored is None else stored.unionByName(payloads.where(good()), allowMissingColumns=True)
    return merged(both).select(*[n for n in both.columns if n in NAMES])


def rag_payloads(queries: DataFrame, hits: DataFrame, replies: DataFrame, application: str, retriever: str = "hybrid") -> DataFrame:
    """One payload for each answered question, for ingest(): its retrieval, and its generation
    or the state `error` where none came back, so that failed questions count. queries:
    query_id, text, seq, start_time; hits: query_id, rank, doc_id, title, content, score;
    replies: query_id, completion, model, provider, input_tokens, output_tokens, duration_ms."""
    doc = F.struct(F.col("doc_id").cast("string").alias("document_id"), F.col("title").cast("string").alias("title"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("final_score"), F.col("content").cast("string").alias("content"), F.lit(None).cast("string").alias("content_preview"))
    near = hits.where(F.col("rank") <= MOST_DOCUMENTS)
    docs = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", doc.alias("d")))).getField("d").alias("_docs"))
    once = replies.groupBy("query_id").agg(F.max(F.struct("completion", "model", "provider", "input_tokens", "output_tokens", "duration_ms")).alias("_r"))
    rows = queries.join(docs, "query_id", "left").join(once, "query_id", "left")
    found = F.coalesce("_docs", F.array().cast(f"array<{DOCUMENT}>"))
    none = lambda kind: F.lit(None).cast(kind)
    retrieval = F.struct(F.col("text").alias("query"), F.lit(retriever).alias("retriever"), F.size(found).alias("top_k"), F.col("start_time").alias("timestamp"), none("double").alias("duration_ms"), found.alias("documents"))
    r = F.col("_r")
    generation = F.struct(r["model"].alias("model"), r["provider"].alias("provider"), none("string").alias("prompt"), r["completion"].alias("completion"), r["input_tokens"].alias("input_tokens"), r["output_tokens"].alias("output_tokens"), r["duration_ms"].alias("duration_ms"), F.lit("success").alias("status"), none("string").alias("span_id"), F.col("start_time").alias("timestamp"))
    made = {
        "seq": F.col("seq"),
        "application": F.lit(application),
        "trace_id": F.col("query_id").cast("string"),
        "kind": F.lit("rag"),
        "start_time": F.col("start_time"),
        "duration_ms": r["duration_ms"],
        "input_text": F.col("text"),
        "output_text": r["completion"],
        "error": F.when(r.isNull(), "the generation failed"),
        "status": F.when(r.isNull(), "error").otherwise("success"),
        "retrievals": F.array(retrieval),
        "generations": F.when(r.isNotNull(), F.array(generation)).otherwise(F.array()),
    }
    made["sent"] = F.array(*(F.lit(c) for c in made if c not in ("seq", "sent")))
    fields = rows.sparkSession.createDataFrame([], PAYLOAD).schema.fields
    return rows.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def new_applications(known: DataFrame, payloads: DataFrame) -> DataFrame:
    """name of the applications that payloads name and `known` (name) lacks."""
    return payloads.where(good()).select(F.col("application").alias("name")).distinct().join(known.select("name"), "name", "left_anti")


def new_users(known: DataFrame, payloads: DataFrame) -> DataFrame:
    """application, external_id of users not yet in `known`."""
    asked = payloads.where(good() & F.col("user_id").isNotNull()).select("application", F.col("user_id").alias("external_id")).distinct()
    return asked.join(known.select("application", "external_id"), ["application", "external_id"], "left_anti")


def upserted_models(known: DataFrame, rows: DataFrame) -> DataFrame:
    """The model registry with rows (the same columns) in place of those of their provider and name."""
    key = ["provider", "name"]
    return known.join(rows.select(*key), key, "left_anti").unionByName(rows)


def seeded_models(known: DataFrame, defaults: DataFrame) -> DataFrame:
    """The model registry with the defaults that it lacks."""
    key = ["provider", "name"]
    return known.unionByName(defaults.join(known.select(*key), key, "left_anti"))


def trace_log(spark: SparkSession, path: str, **sizes: int) -> KeyedLog:
    """The log of traces under path, whose rows are states(); shown() of what it reads are the
    traces."""
    return KeyedLog(spark, path, KEY, joined, **sizes)


def ingest_batch(log: KeyedLog, payloads: DataFrame, batch: int) -> bool:
    """Takes a batch of payloads into the log, and its dead letters into the folder `dead` beside
    it; false if the batch was taken before. The commit has the batch's counters: payloads,
    accepted and dead ones."""
    if batch <= log.commits().batch:
        return False
    # reads the key and the duration only; where no payload is dead none is read for that
    seen = payloads.agg(F.count("*").alias("payloads"), F.count_if(good()).alias("accepted"), F.count_if(~good()).alias("dead")).first().asDict()
    dead_letters(payloads if seen["dead"] else payloads.limit(0)).write.mode("overwrite").parquet(f"{log.path}/dead/b{batch}")
    return log.append(states(payloads), batch, lambda: seen)


def ingest_stream(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str, **sizes: int):
    """Starts a query that drains a stream of payloads into the log under path. The cost of a
    batch follows the batch; one that is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        ingest_batch(trace_log(spark, path, **sizes), batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
