"""Column functions: tokens, cost, ratios, text and evaluation scalars. All are built-in
expressions, which the optimizer sees through. Unmeasured stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of the content-word measure.
STOP_WORDS = """
a an the and or but if then than that this these those of in on at to for from
by with without within into over under about as is are was were be been being am
do does did done have has had having will would shall should can could may might
must it its it's they them their there here what which who whom whose when where
why how all any both each few more most other some such no nor not only own same
so too very s t don now i you he she we us our your my me him her
""".split()
#: Default prices per thousand tokens (model, provider, in, out, window, local).
DEFAULT_PRICES = (
    ("qwen2.5:0.5b", "ollama", 0.0, 0.0, 32768, True),
    ("qwen2.5:3b", "ollama", 0.0, 0.0, 32768, True),
    ("qwen2.5:7b", "ollama", 0.0, 0.0, 32768, True),
    ("llama3:latest", "ollama", 0.0, 0.0, 8192, True),
    ("mistral:latest", "ollama", 0.0, 0.0, 32768, True),
    ("gemma2:2b", "ollama", 0.0, 0.0, 8192, True),
    ("gpt-4o-mini", "openai", 0.00015, 0.00060, 128000, False),
    ("claude-haiku-4-5-20251001", "anthropic", 0.00100, 0.00500, 200000, False),
)
#: The ranges of characters that count as a token each.
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"
#: Weights of duplication, yield and headroom in the token efficiency.
EFFICIENCY = (0.40, 0.25, 0.35)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0.0 where there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def finite(x: Column) -> Column:
    """A number or NULL: NaN and infinities aren't numbers."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(finite(x), F.lit(0.0))))


def estimate_tokens(text: Column) -> Column:
    """Digit runs, Latin runs, other characters one by one; CJK characters one each; a run of
    more than 16 characters counts once for each four, rounded up."""
    rest = F.regexp_replace(text, CJK, " ")
    pieces = F.regexp_extract_all(rest, F.lit(r"(?U)\d+|[A-Za-z]+|[^\s]"), F.lit(0))
    count = F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + F.when(F.length(p) > 16, F.ceil(F.length(p) / 4)).otherwise(F.lit(1)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("long")).otherwise(count + F.regexp_count(text, F.lit(CJK)))


def call_cost(input_tokens: Column, output_tokens: Column, in_price: Column, out_price: Column, is_local: Column) -> Column:
    """Price of a call, 8 digits; 0 for local and unknown models."""
    cost = input_tokens / 1000.0 * in_price + output_tokens / 1000.0 * out_price
    return F.when(F.coalesce(is_local, F.lit(True)), 0.0).otherwise(F.round(cost, 8))


def cost_label(known: Column, is_local: Column, enabled: bool = True) -> Column:
    if not enabled:
        return F.lit("disabled")
    return F.when(~known, "unpriced").when(is_local, "local").otherwise("simulated")


def window_label(labels: Column) -> Column:
    """One label of a window from the set of its models' labels."""
    return F.when(F.size(labels) == 0, "no model calls").when(F.size(labels) == 1, F.get(labels, F.lit(0))).otherwise("mixed")


def mean_present(*values: Column) -> Column:
    """Mean of the values that aren't NULL; NULL without any."""
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)) / n)


def token_efficiency(input_tokens: Column, context_tokens: Column, output_tokens: Column, documents: Column, duplicates: Column) -> Column:
    """struct(score, duplicate_document_count, duplicate_ratio, duplicate_tokens, context_share,
    output_yield, potential_waste_pct, wasted_tokens) of a request; documents and duplicates are
    numbers of documents. Not rounded."""
    zero = F.lit(0).cast("long")
    i, c, o = (F.greatest(zero, F.coalesce(x, zero)) for x in (input_tokens, context_tokens, output_tokens))
    dup = ratio(duplicates.cast("double"), documents)
    share, gain = ratio(c.cast("double"), i), ratio(o.cast("double"), i)
    a, b, d = EFFICIENCY
    yields = F.when(i == 0, 1.0).otherwise(F.least(F.lit(1.0), gain / 0.25))
    room = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - share) / 0.4))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (a * (1 - dup) + b * yields + d * room)))
    dup_tokens = F.floor(c * dup).cast("long")
    wasted = F.least(i, dup_tokens + F.greatest(zero, c - 4 * o))
    return F.struct(
        score.alias("score"),
        duplicates.cast("long").alias("duplicate_document_count"),
        dup.alias("duplicate_ratio"),
        dup_tokens.alias("duplicate_tokens"),
        share.alias("context_share"),
        gain.alias("output_yield"),
        F.when(i == 0, 0.0).otherwise(100.0 * wasted / i).alias("potential_waste_pct"),
        wasted.alias("wasted_tokens"),
    )


def message_tokens(contents: Column) -> Column:
    """Tokens of a chat: those of the contents (an array), 4 for each message and 3 for the answer."""
    return F.aggregate(contents, F.lit(3).cast("long"), lambda n, m: n + 4 + estimate_tokens(F.coalesce(m, F.lit(""))))


def truncate_to_tokens(text: Column, tokens: int) -> Column:
    """At most 4 characters for each token, cut at the last space of those, if there is one."""
    kept = F.left(text, F.lit(4 * tokens))
    at_space = F.regexp_replace(kept, r"(?s)^(.*) [^ ]*$", "$1")
    return F.when(F.lit(tokens <= 0), "").when(F.length(text) <= 4 * tokens, text).otherwise(F.rtrim(at_space))


def slug(name: Column) -> Column:
    """Lower-case letters and digits, joined by single hyphens."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def normalised(text: Column) -> Column:
    """Lower-case text with one space for each run of white space."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def title_fingerprint(title: Column) -> Column:
    return F.trim(F.regexp_replace(normalised(title), "^#+", ""))


def document_text(content: Column, preview: Column) -> Column:
    return F.coalesce(F.when(content != "", content), preview, F.lit(""))


def preview(text: Column, length: int = 200) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def elapsed_ms(start: Column, end: Column) -> Column:
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return F.round(F.greatest(F.lit(0.0), (micros(end) - micros(start)) / 1000.0), 3)


def settled(start: Column, end: Column, duration_ms: Column, status: Column) -> Column:
    """struct(end_time, duration_ms): an end gives the duration; a duration gives the end of a
    request that isn't running any more."""
    over = F.coalesce(status != "running", F.lit(False))
    by = F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + F.round(duration_ms * 1000).cast("long")).cast("timestamp_ntz")
    return F.struct(F.coalesce(end, F.when(over, by)).alias("end_time"), F.coalesce(F.when(end.isNotNull(), elapsed_ms(start, end)), duration_ms).alias("duration_ms"))


def chunk_external_id(source: Column, content_hash: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, content_hash, index.cast("string")), 256), 1, 16)


def words(text: Column) -> Column:
    """Word tokens, lower-cased, Unicode."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def content_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def coverage(needle: Column, hay: Column) -> Column:
    """Share of the words of needle that hay has; 0.0 for no words."""
    return F.when(F.size(needle) == 0, 0.0).otherwise(F.size(F.array_intersect(needle, hay)) / F.size(needle))


def claims(answer: Column) -> Column:
    """Sentences and lines of an answer, of two characters at least."""
    parts = F.split(answer, r"(?<=[.!?])[ \t]+|[\r\n]+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= 2)


#: Words that may stand before a citation's name.
CITATION_KEYS = ("source", "src", "ref", "doc", "document")


def citation_markers(answer: Column) -> Column:
    """Identifiers of the citations of an answer, in their order, repeated ones too: [3], [S3],
    [doc-2] and lists of these by comma, semicolon or slash; [source: x] and (source: x), where
    the key may be source, src, ref, doc or document."""
    # whatever is in brackets, or in parentheses with a word and a colon first
    spans = F.regexp_extract_all(answer, F.lit(r"\[\w+\s*[:=][^\]\r\n]+\]|\[[^\[\]\r\n]+\]|\(\s*\w+\s*[:=][^)\r\n]+\)"), F.lit(0))

    def read(span: Column) -> Column:
        body = F.substring(span, F.lit(2), F.length(span) - 2)
        halves = F.split(body, "[:=]", 2)
        key = F.when(span.startswith("("), F.trim(halves[0])).otherwise(F.rtrim(halves[0]))  # a bracket's key comes at once
        keyed = (F.size(halves) == 2) & F.lower(key).isin(*CITATION_KEYS) & (F.trim(F.get(halves, 1)) != "")
        lists = F.transform(F.regexp_extract_all(span, F.lit(r"\[([^\[\]\r\n]*)\]"), F.lit(1)), lambda inner: F.split(inner, "[,;/]"))
        whole = F.filter(lists, lambda names: F.forall(names, lambda n: n.rlike(r"^\s*[A-Za-z0-9][A-Za-z0-9_.\-]*\s*$")))
        return F.when(keyed, F.array(F.get(halves, 1))).otherwise(F.flatten(whole))

    bare = F.transform(F.flatten(F.transform(spans, read)), lambda n: F.regexp_replace(n, r"^[\s.,;:]+|[\s.,;:]+$", ""))
    names = F.transform(bare, lambda n: F.lower(F.coalesce(F.nullif(F.regexp_extract(n, r"^[A-Za-z]*(\d+)$", 1), F.lit("")), n)))
    return F.filter(names, lambda n: n != "")


def unit_interval(x: Column) -> Column:
    """A judge's number: 0 to 1 as it is, whole 2 to 100 as per cent, anything else NULL."""
    v = finite(x)
    return F.when((v >= 0) & (v <= 1), v).when((v > 1) & (v <= 100) & (v == F.floor(v)), v / 100)


def stored_number(value: Column) -> Column:
    """A metric stored as JSON text, if it is a number: booleans, texts and objects aren't."""
    return F.when(value.rlike(r"^\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"), finite(value.try_cast("double")))


def judge_reply(reply: Column) -> Column:
    """struct(faithfulness, answer_relevance, rationale) of a judge's reply: the whole as JSON,
    else what stands between its outermost braces; NULL if neither is an object."""
    fields = "struct<faithfulness:string,answer_relevance:string,rationale:string>"
    whole = F.from_json(F.when(F.trim(reply).startswith("{") & F.trim(reply).endswith("}"), reply), fields)
    part = F.from_json(F.when(reply.contains("{"), F.regexp_extract(reply, r"(?s)\{.*\}", 0)), fields)
    x = F.coalesce(whole, part)
    seen = F.coalesce(x["faithfulness"], x["answer_relevance"], x["rationale"]).isNotNull()
    return F.when(seen, F.struct(unit_interval(stored_number(x["faithfulness"])).alias("faithfulness"), unit_interval(stored_number(x["answer_relevance"])).alias("answer_relevance"), x["rationale"].alias("rationale")))


def unit_vector(v: Column) -> Column:
    """The vector with length one; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))


def shared_cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)
