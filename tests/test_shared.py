"""Groupings that share scans, against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from raglens.operators import shared
from raglens.operators.shared import Section

SCHEMA = "app long, day string, v double, n long"
SETS = {"all": (), "app": ("app",), "both": ("app", "day")}


def measures():
    return {"rows": F.count("*"), "n": F.coalesce(F.sum("n"), F.lit(0)), "top": F.max("v")}


def _plain(data, keys):
    groups = {}
    for a, d, v, n in data:
        k = (a if "app" in keys else None, d if "day" in keys else None)
        groups.setdefault(k, []).append((v, n))
    return groups


def test_grouped(spark):
    rng = np.random.default_rng(3)
    data = [(None if rng.random() < 0.1 else int(rng.integers(3)), None if rng.random() < 0.1 else f"d{rng.integers(4)}", None if rng.random() < 0.2 else float(rng.integers(50)), int(rng.integers(9))) for _ in range(3000)]
    rows = spark.createDataFrame(data, SCHEMA).repartition(5)
    g = shared.grouped(rows, SETS, measures(), {"p50": 0.5, "p90": 0.9}, "v", ("all", "app"))
    got = {(r["grouping"], r["app"], r["day"]): r for r in g.rows.where("_filler = 0").collect()}
    seen = 0
    for name, keys in SETS.items():
        for (a, d), xs in _plain(data, keys).items():
            r, vs = got[name, a, d], [v for v, _ in xs if v is not None]
            assert (r["rows"], r["n"], r["top"]) == (len(xs), sum(n for _, n in xs), max(vs))
            if name == "both":
                assert r["p50"] is None
            else:
                assert r["p50"] == np.percentile(vs, 50) and abs(r["p90"] - np.percentile(vs, 90)) < 1e-6
            seen += 1
    assert seen == len(got)


def test_report_of_nothing_and_of_a_series(spark):
    parts = (Section("cards", "all", ["rows", "n", "top"]), Section("series", "both", ["rows"], F.col("day")))
    buckets = spark.createDataFrame([("d0",), ("d1",)], "bucket string")
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "d1", 2.0, 5), (1, "d9", 3.0, 1)], SCHEMA)
    for rows, want in ((none, (0.0, 0.0, None, None)), (one, (2.0, 6.0, 3.0, 1.0))):
        g = shared.grouped(rows, {"all": (), "both": ("day",)}, measures())
        out = shared.report(shared.sections(g, *parts), shared.skeleton(buckets, "series", F.col("bucket"), ["rows"]))
        got = {(r["section"], r["key"], r["metric"]): r["value"] for r in out.collect()}
        # an empty bucket has no value, and d9 is outside of the series
        assert got == {("cards", "", "rows"): want[0], ("cards", "", "n"): want[1], ("cards", "", "top"): want[2], ("series", "d0", "rows"): None, ("series", "d1", "rows"): want[3]}


def test_groups_of_one_name_stay_apart_and_limits(spark):
    rows = spark.createDataFrame([(1, "x", 1.0, 5), (2, "x", 1.0, 7), (3, "y", 1.0, 1)], SCHEMA)
    g = shared.kept(shared.grouped(rows, {"all": (), "both": ("app", "day")}, measures()), "both", [F.desc("n")], 2)
    got = sorted((r["section"], r["key"], r["value"]) for r in shared.report(shared.sections(g, Section("a", "both", ["n"], F.col("day")), Section("t", "all", ["n"]))).collect())
    assert got == [("a", "x", 5.0), ("a", "x", 7.0), ("t", "", 13.0)]


def test_page_with_total(spark):
    from datetime import datetime

    from raglens.operators import analytics as an

    at = [datetime(2024, 1, 1 + i // 3) for i in range(10)]  # ties in time
    rows = spark.createDataFrame([(i, at[i], 1.0, "k", "success", "e" if i % 2 else None) for i in range(10)], "trace_id long, start_time timestamp_ntz, duration_ms double, kind string, status string, error string").repartition(3)
    want = sorted(range(10), key=lambda i: (-at[i].timestamp(), i))
    after, seen = None, []
    while True:
        page = an.trace_page(rows, size=4, after=after).collect()
        seen += [r["trace_id"] for r in page]
        assert {r["total"] for r in page} == {10}
        if page[0]["next_trace_id"] is None:
            break
        after = (page[0]["next_start_time"], page[0]["next_trace_id"])
        assert after[1] == page[-1]["trace_id"]
    assert seen == want and len(page) == 2
    assert an.trace_page(rows.where("false")).count() == 0
    assert an.trace_page(rows, size=10).first()["next_trace_id"] is None
