"""Settings, links, items and picks: golden cases, and rectangles against a plain loop."""

import random

from pyspark.sql import functions as F

from texloom.operators import profiles


def test_deep_links(spark):
    urls = ["http://h/?job=a-1", "http://h/?reader=b", "http://h/?job=c&view=reader", "http://h/?reader=d&job=e", "http://h/?job=&reader=f", "http://h/?job", "http://h/", "http://h/?job=%61b#x", "http://h/?job=a%0A", "http://h/?job=" + "x" * 129, None]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(list(enumerate(urls)), "n int, u string").orderBy("n").select(profiles.deep_link(F.col("u"))).collect()]
    assert got == [("a-1", "details"), ("b", "reader"), ("c", "reader"), ("e", "details"), None, None, None, ("ab", "details"), None, None, None]


def test_live_children_of_all_items(spark, tmp_path):
    from texloom import profile_queries
    from texloom.queries import QUERIES

    orders = [(k, k % 7, "P" if k % 4 == 0 else "O") for k in range(1, 60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(c,) for c in range(1, 9)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    of = {10**9 + k: c for k, c, _ in orders} | {c: c for c in range(1, 9)}
    want = sorted((i, p, 10**9 + k) for i, p in of.items() for k, c, s in orders if c == p and s != "P")
    assert profile_queries and sorted(map(tuple, QUERIES["live_children"](spark, str(tmp_path)).collect())) == want


def test_merged_rects(spark):
    rng = random.Random(6)
    pages = [[(rng.randrange(20) / 20, rng.choice((0.1, 0.101, 0.3)), rng.choice((0.04, 0.1)), rng.choice((0.02, 0.05))) for _ in range(rng.randrange(12))] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(pages)), "n int, r array<struct<x:double,y:double,width:double,height:double>>")
    for row in df.select("n", profiles.merged_rects(F.col("r")).alias("m")).collect():
        want = []
        for x, y, w, h in sorted(pages[row["n"]], key=lambda r: (r[1], r[0])):
            hit = next((p for p in want if abs(p[1] - y) < 0.002 and abs(p[3] - h) < 0.004 and x <= p[0] + p[2] + 0.002 and x + w >= p[0]), None)
            if hit is None:
                want.append([x, y, w, h])
            else:
                end = max(hit[0] + hit[2], x + w)
                hit[0] = min(hit[0], x)
                hit[2] = end - hit[0]
        assert [tuple(m) for m in row["m"]] == [tuple(p) for p in want]


def test_merge_settings(spark):
    shape = "id int, base_url string, model string, api_key string, extra_headers map<string,string>"
    old = spark.createDataFrame([(i, "u0", "m", "old", {"h": "1"}) for i in range(5)], shape)
    new = spark.createDataFrame([(0, None, "n", None, None, None), (1, "u1", None, None, None, None), (2, "u2", None, "", None, None), (3, None, None, "k", True, {}), (4, None, None, None, True, None)], "id int, base_url string, model string, api_key string, clear_api_key boolean, extra_headers map<string,string>")
    saved = spark.createDataFrame([(1, "u1", "x", "saved", {"s": "2"})], shape)
    got = {r[0]: tuple(r)[1:] for r in profiles.merge(old, new, saved).collect()}
    assert got == {0: ("u0", "n", "old", {"h": "1"}), 1: ("u1", "m", "saved", {"s": "2"}), 2: ("u2", "m", "", {}), 3: ("u0", "m", "k", {}), 4: ("u0", "m", "", {"h": "1"})}


def test_localized(spark):
    df = spark.createDataFrame([("abc", "abc", ["1 pages abc", None], [("x abc", "abc")]), (None, None, None, None)], "message string, name string, warnings array<string>, inner array<struct<error:string,kind:string>>")
    got = profiles.localized_payload(df, {"abc": "d"}, [("^1 p", "1 p")]).collect()
    assert tuple(got[0]) == ("d", "abc", ["1 page d", None], [("x d", "abc")]) and tuple(got[1]) == (None, None, None, None)


def test_sources(spark):
    shape = "id int, paper_id string, official boolean, originals int, evidence string, accepted boolean"
    asked = spark.createDataFrame([(0, None, None, 1, None, None), (1, "2401.00001v1", False, 1, None, None), (2, "2401.00001v1", True, 0, None, None), (3, "2401.00001", False, 1, "attachment", None), (4, "2401.00001", False, 1, None, False), (5, "2401.00002", False, 0, None, None)], shape)
    known = spark.createDataFrame([("2401.00001", "2401.00001v4")], "base string, version string")
    got = {r[0]: (r[1], r[2]) for r in profiles.completed_sources(asked, known).collect()}
    assert got == {0: (None, "kept"), 1: ("2401.00001v1", "kept"), 2: ("2401.00001v1", "official"), 3: ("2401.00001v4", "official"), 4: (None, "none"), 5: (None, "conflict")}
