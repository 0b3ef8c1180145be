"""Golden cases and properties of the engine's operators."""

import random

import pytest
from pyspark.sql import functions as F

from texloom.functions import ids, text
from texloom.plans.tables import cut
from texloom.operators import align, graph, library, segments


def values(spark, column, rows, shape="v string"):
    return [r[0] for r in spark.createDataFrame([(i, *([r] if not isinstance(r, tuple) else r)) for i, r in enumerate(rows)], "n int, " + shape).orderBy("n").select(column).collect()]


def test_paper_ids(spark):
    rows = ["2401.01234", "arXiv:2401.01234v2", "https://arxiv.org/pdf/2401.01234v3.pdf", "http://www.arxiv.org/abs/hep-th/9901001", "https://example.org/abs/2401.01234", "2401.1", None]
    assert values(spark, ids.paper_id(F.col("v")), rows) == ["2401.01234", "2401.01234v2", "2401.01234v3", "hep-th/9901001", None, None, None]
    assert values(spark, ids.is_versioned(F.col("v")), ["a", "2401.01234v2", "x v0"]) == [False, True, False]


def test_text(spark):
    assert values(spark, text.redact(F.col("v"), ["tok", "token"]), ["a token sk-a.b c"]) == ["a [hidden] [hidden] c"]
    assert values(spark, text.error_detail(F.col("v")), ["x  Bearer abc\n y" + "z" * 600])[0].endswith("z…")
    assert values(spark, text.limit_context(F.col("v"), 20), ["short  text", "One sentence here. And more", "word " * 9, "x" * 30]) == ["short text", "One sentence here.…", "word word word word…", "x" * 19 + "…"]
    assert values(spark, text.generated_error(F.col("v")), ["ok", "a \\b", "$x$", "⟪"]) == [None, "extra_command", "extra_command", "invalid_format"]
    assert values(spark, text.safe_path(F.col("v")), ["a/b", "/a", "a/../b", "a\\..\\b", "c:/x"]) == [True, False, False, False, False]
    assert values(spark, text.windows_path(F.col("v")), ["a/b.tex", "con.txt", "a?b", "dir /x"]) == [True, False, False, False]


def test_chain():
    assert align.heaviest_chain([1, 2, 3, 4], [1, 9, 2, 3], [12, 1, 10, 12]) == [0, 2, 3]
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 14)
        p = sorted((rng.randrange(6) / 2, rng.randrange(6) / 2, rng.choice((2, 3, 10))) for _ in range(n))
        x, y, w = map(list, zip(*p))
        score, before = [], []
        for i in range(n):
            best, b = w[i], -1
            for j in range(i):
                if x[j] < x[i] - 1e-7 and y[j] < y[i] - 1e-7 and score[j] + w[i] > best:
                    best, b = score[j] + w[i], j
            score.append(best)
            before.append(b)
        at, want = score.index(max(score)), []
        while at >= 0:
            want.append(at)
            at = before[at]
        assert align.heaviest_chain(x, y, w) == want[::-1]


def test_batches():
    assert [b for _, b in align.greedy_batches(enumerate([5, 5, 5, 20, 1]), 2, 12)] == [0, 0, 1, 2, 3]


def test_reuse(spark):
    jobs = spark.createDataFrame([(1, "arxiv", 7, "en", "completed", 5, ["w"], True), (2, "arxiv", 7, "en", "completed", 1, [], True), (3, "arxiv", 7, "en", "queued", 9, [], False), (4, "arxiv", 8, "en", "completed", 1, [], False)], "id int, kind string, source_id int, language string, status string, created_at long, warnings array<string>, readable boolean")
    asked = spark.createDataFrame([(10, "arxiv", 7, "en"), (11, "arxiv", 8, "en")], "request_id int, kind string, source_id int, language string")
    assert sorted(map(tuple, library.reusable(asked, jobs).collect())) == [(10, 2, 0), (11, None, None)]


def test_roles(spark):
    edges = spark.createDataFrame([("p", "a", "b", False), ("p", "b", "a", False), ("p", "a", "c", True), ("p", "b", "d", False), ("p", "c", "d", False)], "project string, src string, dst string, opaque boolean")
    nodes = spark.createDataFrame([("p", x) for x in "abcde"], "project string, node string")
    got = {r["node"]: r["role"] for r in graph.roles(edges, nodes.where("node = 'a'"), nodes).collect()}
    assert got == {"a": "open", "b": "open", "c": "opaque", "d": "mixed", "e": "open"}


def plain_roles(edges, root, nodes):
    """GR2 by brute force: visit the root, then each node without a context, in order."""
    found = {v: set() for v in nodes}
    for start in [root, *nodes]:
        pending = [] if found[start] else [(start, False)]
        while pending:
            v, opaque = pending.pop()
            if opaque not in found[v]:
                found[v].add(opaque)
                pending += [(d, opaque or cut) for s, d, cut in edges if s == v]
    return {v: "mixed" if len(f) == 2 else "opaque" if True in f else "open" for v, f in found.items()}


def test_roles_below_unreached_nodes(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(30), rng.randrange(30), rng.random() < 0.4) for _ in range(28)]
    e = spark.createDataFrame([("p", *x) for x in edges], "project string, src int, dst int, opaque boolean")
    nodes = spark.createDataFrame([("p", i) for i in range(30)], "project string, node int")
    got = {r["node"]: r["role"] for r in graph.roles(e, nodes.where("node = 0"), nodes).collect()}
    assert got == plain_roles(edges, 0, range(30)) and len(set(got.values())) > 1


@pytest.mark.parametrize("seed", [1, 2])
def test_roles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(i + 3), i, rng.random() < 0.3) for i in range(1, 40)] + [(rng.randrange(40), rng.randrange(40), rng.random() < 0.5) for _ in range(6)]
    e = spark.createDataFrame([("p", *x) for x in edges], "project string, src int, dst int, opaque boolean")
    nodes = spark.createDataFrame([("p", i) for i in range(45)], "project string, node int")
    got = {r["node"]: r["role"] for r in graph.roles(e, nodes.where("node = 0"), nodes).collect()}
    assert got == plain_roles(edges, 0, range(45))


def test_unmask(spark):
    df = spark.createDataFrame([("a ⟪P0000⟫ b ⟪P0001⟫", ["$x$", "5"]), ("plain", [])], "m string, p array<string>")
    assert [r[0] for r in df.select(segments.unmask(F.col("m"), F.col("p"))).collect()] == ["a $x$ b 5", "plain"]


@pytest.mark.parametrize("name", ["reusable_result", "asof_interpolation", "writeback"])
def test_no_product(spark, name):
    from texloom.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_reachability_of_deep_chains(spark):
    edges = spark.createDataFrame([("p", i, i + 1) for i in range(66)], "project string, src int, dst int").coalesce(1)
    root = spark.createDataFrame([("p", 0)], "project string, node int").coalesce(1)
    assert graph.reachable(edges, root).count() == 67


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """A chain of 3,000 with a join, a ring and branches off it takes rounds by its binary digits."""
    made = []
    monkeypatch.setattr(graph, "cut", lambda df, *a: made.append(1) or cut(df, *a))
    chain = [(i, i + 1, i == 1500) for i in range(3000)]
    edges = chain + [(10, 5000, False), (5000, 5001, True), (5001, 2000, False), (7000, 7001, False), (7001, 7000, False), (7001, 7002, False), (3000, 3000, False)]
    e = spark.createDataFrame([("p", *x) for x in edges], "project string, src int, dst int, opaque boolean").coalesce(2)
    root = spark.createDataFrame([("p", 0)], "project string, node int").coalesce(1)
    assert {r["node"] for r in graph.reachable(e, root).collect()} == {*range(3001), 5000, 5001} and len(made) < 30
    nodes = spark.createDataFrame([("p", i) for i in (0, 1500, 1501, 1999, 2000, 3000, 5001, 9000)], "project string, node int")
    got = {r["node"]: r["role"] for r in graph.rooted_roles(e, root, nodes).collect()}
    assert got == {0: "open", 1500: "open", 1501: "opaque", 1999: "opaque", 2000: "opaque", 3000: "opaque", 5001: "opaque", 9000: "open"}


def plain_mapper(pairs, heights):
    """JN6 and AR4 for one pair of documents."""
    starts = {}
    for side, h in heights.items():
        starts[side] = [0.0]
        for x in h:
            starts[side].append(starts[side][-1] + x)
    o_end, t_end = starts["original"][-1], starts["translated"][-1]
    marks = [(0.0, 0.0), *sorted(p for p in pairs if 0 < p[0] < o_end and 0 < p[1] < t_end), (o_end, t_end)]
    rises = all(b[0] > a[0] and b[1] > a[1] for a, b in zip(marks, marks[1:]))

    def to(page, fraction):
        n, fraction = len(heights["translated"]), max(0.0, min(1.0, fraction))
        if not pairs or not rises:
            return max(1, min(n, page)), fraction
        i = max(0, min(len(heights["original"]) - 1, page - 1))
        v = starts["original"][i] + fraction * heights["original"][i]
        k = max(j for j, m in enumerate(marks[:-1]) if j == 0 or m[0] <= v)
        a, b = marks[k], marks[k + 1]
        y = a[1] + max(0.0, min(1.0, (v - a[0]) / (b[0] - a[0]))) * (b[1] - a[1])
        j = max([0, *(x for x in range(n) if starts["translated"][x] <= y)])
        return j + 1, max(0.0, min(1.0, (y - starts["translated"][j]) / heights["translated"][j]))

    return to


def test_positions(spark):
    rng = random.Random(6)
    pairs, heights, asked, want = [], [], [], {}
    for d in range(40):
        h = {s: [rng.choice((0.5, 1.0, 1.5)) for _ in range(rng.randrange(1, 5))] for s in ("original", "translated")}
        ends = [sum(h[s]) for s in ("original", "translated")]
        marks = [(rng.randrange(0, 9) / 8 * ends[0], rng.randrange(0, 9) / 8 * ends[1]) for _ in range(rng.randrange(0, 4))]
        if d % 2:
            marks = list(zip(sorted({m[0] for m in marks}), sorted({m[1] for m in marks})))
        pairs += [(d, *map(float, m)) for m in marks]
        heights += [(d, s, i + 1, x) for s in h for i, x in enumerate(h[s])]
        to = plain_mapper(marks, h)
        for _ in range(12):
            q = (rng.randrange(-1, 7), rng.choice((-0.5, 0.0, 0.25, 0.5, 1.0, 1.5)))
            want[len(asked)] = to(*q)
            asked.append((d, len(asked), *q))
    got = align.map_positions(
        spark.createDataFrame(asked, "pair_id int, query_id int, page int, fraction double"), spark.createDataFrame(pairs, "pair_id int, original double, translated double"), spark.createDataFrame(heights, "pair_id int, side string, page int, ratio double")
    )
    got = {r["query_id"]: (r["page"], r["fraction"]) for r in got.collect()}
    assert got.keys() == want.keys() and len({w[0] for w in want.values()}) > 3
    for q, (page, fraction) in want.items():
        assert got[q][0] == page and abs(got[q][1] - fraction) < 1e-9


def test_batches_stream(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, "x" * rng.randrange(0, 9) if i % 9 else None) for i in range(200)]
    got = {(r["k"], r["ord"]): r["batch"] for r in align.batches(spark.createDataFrame(rows, "k string, ord long, text string"), "k", 4, 17).collect()}
    for k in "abc":
        own = [(o, len(t or "")) for x, o, t in rows if x == k]
        assert [got[(k, o)] for o, _ in own] == [b for _, b in align.greedy_batches(own, 4, 17)]


def test_lookup_and_markers(spark):
    from texloom.functions import records

    jobs = spark.createDataFrame([(1, "a")], "id int, name string")
    assert library.get(jobs, 1).first()["name"] == "a"
    with pytest.raises(LookupError):
        library.get(jobs, 2)
    piece = "⟪P0012⟫ a ⟪P0003⟫"
    assert values(spark, records.local_markers(F.col("v")), [piece, "none"]) == [("⟪P0000⟫ a ⟪P0001⟫", ["⟪P0012⟫", "⟪P0003⟫"]), ("none", [])]
    back = records.global_markers(F.lit("b ⟪P0001⟫⟪P0000⟫ ⟪P0009⟫"), records.local_markers(F.col("v"))["originals"])
    assert values(spark, back, [piece]) == ["b ⟪P0003⟫⟪P0012⟫ ⟪P0009⟫"]
