"""The queries op1 to op13 over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raglens.llm import decontaminate, fingerprint, html, jaccard, langid, lm, merkle, minhash, mixing, resample, toxicity, urlfilter, warc
from raglens.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 5) == 0
    model = langid.fit(docs.where(~held_out))
    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), langid.predict(spark, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", html.extract(spark).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, crc_mod("doc_id", 5) == 1)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(_table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = crc_mod("doc_id", 4) == 2
    grammar = toxicity.fit(toxicity.labelled(docs, labels.where(~held_out)))
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), toxicity.score(spark, grammar).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2, num=80, den=100)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return resample.resampled(docs, benchmark, orders=1, buckets=10_000, percent=10, least=20, seed=2024)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), merkle.chosen("doc_id", 5)).proofs()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_language_id, op2_ngram_jaccard_join, op3_source_mixing, op4_html_extraction, op5_decontamination, op6_lm_scoring, op7_url_filter, op8_fingerprints, op9_warc, op10_toxicity, op11_minhash_near_dedup, op12_importance_resampling, op13_merkle_manifest)
    return {f.__name__: f for f in ops}


def _components(words: int, num: int, columns: str) -> str:
    """Links of shingle sets and their components, as SQL."""
    shingle = " || ' ' || ".join(f"ws[i + {j}]" if j else "ws[i]" for j in range(words))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {words - 2}), lambda i: {shingle})) END AS sh
  FROM w),
k AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS g FROM k),
o AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {num} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM o UNION SELECT b, a FROM o),
r(node, root) AS (SELECT rep, rep FROM k UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, {columns}
FROM s LEFT JOIN k ON list_sort(s.sh) = k.sh LEFT JOIN c ON c.node = k.rep
"""


_OP2 = _components(3, 90, "coalesce(c.root, s.doc_id) AS component_id")
_OP11 = _components(2, 80, "coalesce(c.root, s.doc_id) AS component_id, s.doc_id = coalesce(c.root, s.doc_id) AS kept")

_OP7 = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
t AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM t
"""

_OP9 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS kept FROM p GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * i + 1)::BIGINT, 5))::INTEGER >> s) & 31) + 1)::BIGINT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM p JOIN k USING (h)
"""




def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text, as SQL."""
    code = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    step = "list_reduce([xor(acc, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {code}), lambda acc, b: {step}), 4294967295)"


_OP12 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT doc_id, unnest(ws) AS w FROM d),
v AS (SELECT w, {_crc32('w')} % 10000 AS k FROM (SELECT w FROM x UNION SELECT w FROM b)),
s AS (SELECT k, count(*)::DOUBLE AS s FROM x JOIN v USING (w) GROUP BY k),
t AS (SELECT k, count(*)::DOUBLE AS t FROM b JOIN v USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000)) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
m AS (SELECT doc_id, sum(gain)::BIGINT AS z FROM x JOIN v USING (w) JOIN g USING (k) GROUP BY doc_id),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE (z - ((z % len(ws)) + len(ws)) % len(ws)) // len(ws) END::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= 20)
SELECT c.*, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)
"""


def _op13(levels: int = 5, upper: int = 4) -> str:
    """Levels of each source's tree, then of the tree over the subroots; with one node left, a
    level changes nothing."""
    framed = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"l AS (SELECT doc_id, coalesce('=' || source, '') AS src, {framed('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {framed(lower)} END AS changed FROM documents)",
        "r0 AS (SELECT doc_id, src, leaf, coalesce(changed, leaf) AS cur, '' AS proof, row_number() OVER (PARTITION BY src ORDER BY doc_id, leaf) - 1 AS pos FROM l)",
        "n0 AS (SELECT src, pos, leaf AS h, count(*) OVER (PARTITION BY src) AS c FROM r0)",
    ]

    def level(i: int) -> list[str]:
        others = lambda op: f"array_to_string(list_filter(g.hs, lambda h, j: j - 1 {op} r.pos % 16), '')"
        return [
            f"g{i} AS (SELECT src, pos // 16 AS pos, c, list(h ORDER BY pos) AS hs FROM n{i} GROUP BY ALL)",
            f"n{i + 1} AS (SELECT src, pos, CASE WHEN c = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, count(*) OVER (PARTITION BY src) AS c FROM g{i})",
            f"r{i + 1} AS (SELECT r.* EXCLUDE (cur, proof, pos), CASE WHEN c = 1 THEN cur ELSE sha256({others('<')} || cur || {others('>')}) END AS cur, CASE WHEN c = 1 THEN proof ELSE proof || {others('<>')} END AS proof, r.pos // 16 AS pos FROM r{i} r JOIN g{i} g ON g.src = r.src AND g.pos = r.pos // 16)",
        ]

    for i in range(levels):
        parts += level(i)
    m = levels + 1
    parts += [
        f"u AS (SELECT src AS name, h AS subroot, row_number() OVER (ORDER BY src) - 1 AS pos FROM n{levels})",
        f"r{m} AS (SELECT doc_id, leaf, subroot, '' AS src, cur, proof, u.pos FROM r{levels} r JOIN u ON u.name = r.src)",
        f"n{m} AS (SELECT '' AS src, pos, subroot AS h, count(*) OVER () AS c FROM u)",
    ]
    for i in range(m, m + upper):
        parts += level(i)
    end = m + upper
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM r{end} r JOIN n{end} n USING (src)"


_OP13 = _op13()


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": _OP2, "op7_url_filter": _OP7, "op9_warc": _OP9, "op11_minhash_near_dedup": _OP11, "op12_importance_resampling": _OP12, "op13_merkle_manifest": _OP13}
