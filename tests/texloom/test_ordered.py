"""Scans over parts, interval joins, batches and the region scan against plain Python, with keys that hold most rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from texloom.operators import align, chains, regions
from texloom.plans import intervals, ordered
from texloom.streaming.changes import patched_batch


@pytest.fixture
def parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_scans(spark, parts):
    rng = random.Random(1)
    rows = [(k, i, rng.choice((None, 1, 2, 5)), rng.randrange(100)) for k, n in (("hot", 400), ("b", 3), (None, 9)) for i in range(n)]
    d = ordered.dealt(spark.createDataFrame(rows, "k string, i int, v int, x long").repartition(4), ["k"], ["i"])
    assert d.where("k = 'hot'").select(ordered.PART).distinct().count() > 2
    got = {(r["k"], r["i"]): r for r in ordered.running(d, ["k"], {"x": "s"}, {"x": "e"}).collect()}
    near = {(r["k"], r["i"]): r for r in ordered.neighbour(d, ["k"], {"x": "px", "v": "pv"}).collect()}
    around = {(r["k"], r["i"]): r for r in ordered.surrounding(d, ["k"], "v", "lo", "hi").collect()}
    assert len(got) == len(near) == len(around) == len(rows)
    for k in ("hot", "b", None):
        own = [r for r in rows if r[0] == k]
        total = xor = 0
        for n, (_, i, v, x) in enumerate(own):
            assert (got[k, i]["s"], got[k, i]["e"]) == (total, xor)
            total, xor = total + x, xor ^ x
            assert (near[k, i]["px"], near[k, i]["pv"]) == ((own[n - 1][3], own[n - 1][2]) if n else (None, None))
            low = [r[2] for r in own[: n + 1] if r[2] is not None]
            high = [r[2] for r in own[n + 1 :] if r[2] is not None]
            assert (around[k, i]["lo"], around[k, i]["hi"]) == (low[-1] if low else None, high[0] if high else None)
    empty = ordered.dealt(spark.createDataFrame([], "k string, i int, v int, x long"), ["k"], ["i"])
    assert ordered.running(empty, ["k"], {"x": "s"}).count() == ordered.neighbour(empty, ["k"], {"x": "p"}).count() == 0


def test_overlapping(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.choice((1, 1, 1, 2)), i, a, a + rng.choice((0, 1, 3, 30, -1))) for i in range(n) for a in [rng.randrange(-20, 60)]]
    left, right = make(120) + [(1, 900, None, 3), (None, 901, 1, 2)], make(120)
    want = sorted((i, j) for k, i, a, b in left for m, j, c, d in right if k == m and a is not None and a <= b and c <= d and a <= d and c <= b)
    one, two = spark.createDataFrame(left, "k int, i int, a int, b int"), spark.createDataFrame(right, "k int, j int, c int, d int")
    for width in (1, 7, 64):
        assert sorted(map(tuple, intervals.overlapping(one, two, ["k"], ("a", "b"), ("c", "d"), width).select("i", "j").collect())) == want


def test_positions_in_one_region(spark, parts):
    rng = random.Random(3)
    rows = [(1 if i % 5 else 2, rng.randrange(2), rng.randrange(30) / 30, rng.randrange(31) / 30, rng.randrange(4), 0.25, rng.choice((0.5, 0.2))) for i in range(300)] + [(1, 0, 0.5, 0.6, 1, 0.0, 0.5)] * 2
    asked = [(1 if i % 3 else 2, i, rng.randrange(2), rng.choice((None, i % 31 / 30))) for i in range(200)]
    r = spark.createDataFrame(rows, "pair_id int, source_page int, source_start double, source_end double, target_page int, target_start double, target_end double")
    p = spark.createDataFrame(asked, "pair_id int, position_id int, page int, fraction double")
    want = {}
    for pair, i, page, f in asked:
        inside = [x for x in rows if f is not None and x[0] == pair and x[1] == page and x[3] > x[2] and x[6] > x[5] and x[2] <= f <= x[3]]
        if len(inside) == 1:
            x = inside[0]
            want[i] = (x[4], pytest.approx(x[5] + (f - x[2]) / (x[3] - x[2]) * (x[6] - x[5])))
    got = {x["position_id"]: (x["page"], x["fraction"]) for x in align.in_one_region(p, r).collect()}
    assert got == want


def test_positions_with_few_regions(spark):
    r = spark.createDataFrame([(1, 1, 0.0, 0.5, 3, 0.0, 1.0), (1, 1, 0.4, 0.9, 4, 0.0, 1.0)], "pair_id int, source_page int, source_start double, source_end double, target_page int, target_start double, target_end double")
    p = spark.createDataFrame([(1, n, 1, f) for n, f in enumerate((0.0, 0.25, 0.4, 0.45, 0.5, 0.9, 0.95))], "pair_id int, position_id int, page int, fraction double")
    got = {x["position_id"]: (x["page"], round(x["fraction"], 6)) for x in align.in_one_region(p, r).collect()}
    assert got == {0: (3, 0.0), 1: (3, 0.5), 5: (4, 1.0)}


@pytest.mark.parametrize("block", [51, 64, 1000])
def test_batches_of_a_hot_key(spark, parts, block):
    rng = random.Random(block)
    rows = [("hot" if i % 10 else rng.choice(("a", None)), i, "x" * rng.choice((0, 1, 5, 20, 90, 300)) if i % 17 else None) for i in range(3000)]
    got = {(r["k"], r["ord"]): r["batch"] for r in align.batches(spark.createDataFrame(rows, "k string, ord long, text string").repartition(3), "k", 50, 400, block).collect()}
    for k in ("hot", "a", None):
        own = [(i, len(t or "")) for key, i, t in rows if key == k]
        assert {i: b for (key, i), b in got.items() if key == k} == dict(align.greedy_batches(iter(own), 50, 400))
    assert len(got) == len(rows)
    assert align.batches(spark.createDataFrame([], "k string, ord long, text string"), "k").collect() == []


def brute_regions(operations, objects, boxes):
    out = []
    for page in {o[0] for o in operations if o[0] is not None}:
        matrix, stack = regions.IDENTITY, []
        for _, order, op, args, name in sorted((o for o in operations if o[0] == page), key=lambda o: o[1]):
            if op == "q":
                stack.append(matrix)
            elif op == "Q":
                matrix = stack.pop() if stack else regions.IDENTITY
            elif op == "cm" and args is not None and len(args) == 6:
                matrix = regions.product(tuple(args), matrix)
            elif op == "Do":
                for p, n, kind, bounds, own, signature in objects:
                    box = boxes.get(page)
                    if (p, n) != (page, name) or kind not in ("/Form", "/Image") or signature is None or box is None:
                        continue
                    a, b, c, d, e, f = regions.product(own or regions.IDENTITY, matrix)
                    x0, y0, x1, y1 = bounds or (0, 0, 1, 1)
                    xs, ys = zip(*[(a * x + c * y + e, b * x + d * y + f) for x in (x0, x1) for y in (y0, y1)])
                    left, bottom, right, top, turn = box
                    if (max(xs) - min(xs)) / (right - left) < 0.1 or (max(ys) - min(ys)) / (top - bottom) < 0.04:
                        continue
                    fractions = {90: [(x - left) / (right - left) for x in xs], 180: [(y - bottom) / (top - bottom) for y in ys], 270: [1 - (x - left) / (right - left) for x in xs]}.get(turn % 360, [(top - y) / (top - bottom) for y in ys])
                    start, end = max(0, min(fractions)), min(1, max(fractions))
                    if end > start:
                        out.append((page, order, signature, start, end))
    return sorted(out)


def test_regions_of_pages_over_many_parts(spark, parts):
    rng = random.Random(5)
    moves = ([1, 0, 0, 1, 3, -2], [0, 1, -1, 0, 0, 0], [-1, 0, 0, 1, 0, 4], [0.5, 0, 0, 2, 0, 0], [1, 2], None)
    operations = []
    for page, n, kinds in ((1, 900, "qQcD"), (2, 40, "qcD"), (3, 30, "QcD"), (4, 5, "D"), (None, 4, "qcD")):
        for i in range(n):
            kind = rng.choice(kinds) if i % 90 > 20 or page != 1 else "qQ"[i // 90 % 2]
            operations.append((page, i, {"c": "cm", "D": "Do"}.get(kind, kind), [float(x) for x in m] if kind == "c" and (m := rng.choice(moves)) else None, f"x{rng.randrange(4)}" if kind == "D" else None))
    objects = [(p, f"x{k}", ("/Form", "/Image", "/Form", "/PS")[k], [-4.0, -2.0, 10.0 + k, 12.0] if k else None, [2.0, 0.0, 0.0, 1.0, 1.0, 1.0] if k == 2 else None, f"s{k}" if p != 4 or k else None) for p in (1, 2, 3, 4) for k in range(4)]
    boxes = {p: (-30.0, -30.0, 34.0, 34.0, 90 * p) for p in (1, 2, 3)}
    o = spark.createDataFrame(operations, "page_id long, ord long, op string, args array<double>, name string").repartition(4)
    x = spark.createDataFrame(objects, "page_id long, name string, subtype string, bounds array<double>, matrix array<double>, signature string")
    b = spark.createDataFrame([(p, *v) for p, v in boxes.items()], "page_id long, left double, bottom double, right double, top double, rotation int")
    got = sorted(map(tuple, regions.graphic_regions(o, x, b).collect()))
    want = brute_regions(operations, objects, boxes)
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(want) > 10
    assert [g[3:] for g in got] == [pytest.approx(w[3:]) for w in want]
    assert regions.graphic_regions(o.limit(0), x, b).collect() == []


def test_effects_combine_in_any_grouping():
    rng = random.Random(6)
    for _ in range(200):
        ops = [rng.choice("qQm") for _ in range(30)]
        whole, pieces, now = regions.Effect(), [], regions.Effect()
        for n, op in enumerate(ops):
            m = tuple(float(rng.randrange(-2, 3)) for _ in range(6))
            for e in (whole, now):
                e.save() if op == "q" else e.restore() if op == "Q" else e.move(m)
            if rng.random() < 0.2:
                pieces.append(now)
                now = regions.Effect()
        left = regions.Effect()
        for p in [*pieces, now]:
            left = left.then(p)
        assert (left.pops, left.frames) == (whole.pops, whole.frames)


def slow_chain(points):
    points = sorted(points, key=lambda r: (r[2], -r[4], r[1]))
    score, before = [], []
    for i, (_, _, x, y, w) in enumerate(points):
        best, k = 0, -1
        for j in range(i):
            if points[j][2] < x - 1e-7 and points[j][3] < y - 1e-7 and score[j] > best:
                best, k = score[j], j
        score.append(best + w)
        before.append(k)
    at, out = max(range(len(points)), key=lambda i: (score[i], -i)), []
    while at >= 0:
        out.append(points[at])
        at = before[at]
    return [(*r, i + 1) for i, r in enumerate(out[::-1])]


def test_chains_on_a_grid(spark):
    rng = random.Random(1)
    rows = [(1, f"n{i}", rng.randrange(40) / 8, rng.randrange(40) / 8, rng.choice((12, 2, 2))) for i in range(220)]
    rows += [(2, f"n{i}", i / 7 + rng.random() / 50, i / 7 + rng.random() / 3, rng.choice((12, 10, 4))) for i in range(90)] + [(3, "a", 1.0, 1.0, 3), (3, "b", 1.0 + 5e-8, 2.0, 3), (3, "b", 1.0, 1.0, 3)]
    d = spark.createDataFrame(rows, "pair_id long, name string, original double, translated double, weight int").repartition(3)
    want = sorted(r for p in (1, 2, 3) for r in slow_chain([x for x in rows if x[0] == p]))
    assert sorted(map(tuple, align.chains(d, 60).collect())) == want
    assert sorted(map(tuple, align.chains(d).collect())) == want


def test_cells_score_as_one_list_does():
    """Any grid gives the chain of the whole, ties included."""
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(1, 60)
        points = sorted(((rng.randrange(12) / 4, rng.randrange(12) / 4, rng.choice((1.0, 1.0, 2.0))) for _ in range(n)), key=lambda p: (p[0], -p[2]))
        rows = [(0, "", x, y, w) for x, y, w in points]
        keep = align.heaviest_chain(*map(list, zip(*points)))
        whole = chains.scores(*map(list, zip(*points)), list(range(n)), [chains.NONE] * n)
        cuts = sorted({rng.randrange(13) / 4 for _ in range(3)})
        cell = lambda v: sum(v >= c for c in cuts)
        inbox, score, before = [], {}, {}
        for r in range(2 * len(cuts) + 1):
            for a in range(r + 1):
                own = [{"pair_id": 0, "a": a, "b": r - a, "kind": chains.POINT, "x": x, "y": y, "score": w, "pos": i, "before": -1, "out": -1} for i, (x, y, w) in enumerate(points) if (cell(x), cell(y)) == (a, r - a)]
                group = pd.DataFrame(own + [m for m in inbox if (m["a"], m["b"]) == (a, r - a)])
                if len(group):
                    found = chains._cell(group)
                    score |= {m["pos"]: m["score"] for m in found[found["kind"] == chains.POINT].to_dict("records")}
                    before |= {m["pos"]: m["before"] for m in found[found["kind"] == chains.POINT].to_dict("records")}
                    inbox += found[found["kind"] != chains.POINT].to_dict("records")
        assert [score[i] for i in range(n)] == whole[0]
        at, out = max(range(n), key=lambda i: (score[i], -i)), []
        while at >= 0:
            out.append(at)
            at = before[at]
        assert out[::-1] == keep and [r[:5] for r in slow_chain(rows)] == [rows[i] for i in keep]


def test_patches_in_batch(spark):
    rng = random.Random(8)
    rows = [(rng.choice((1, 1, 2, None)), i, rng.choice((0, 1, 2, 3, None)), rng.random() < 0.05 if i % 3 else None, f"v{i}") for i in range(300)]
    got = {r["id"]: tuple(r)[1:] for r in patched_batch(spark.createDataFrame(rows, "id long, at int, asked int, gone boolean, value string").repartition(3)).collect()}
    want = {}
    for key in (1, 2):
        state = [0, False, None, 0, 0]
        for _, _, asked, gone, value in (r for r in rows if r[0] == key):
            if not state[1] and asked == state[0]:
                state = [state[0] + 1, bool(gone), value, state[3] + 1, state[4]]
            else:
                state[4] += 1
        want[key] = tuple(state)
    assert got == want
    assert patched_batch(spark.createDataFrame([], "id long, at int, asked int, gone boolean, value string")).collect() == []


def test_regions_of_captions_that_stand_alike(spark):
    rng = random.Random(5)
    captions = [(i % 3, f"c{i}", i % 4, i % 5, rng.randrange(20) / 20, rng.choice((None, 0.1, 0.5, 0.9))) for i in range(300)] + [(0, "twice", 0, 0, 0.5, 0.5)] * 2 + [(None, "none", 0, 0, 0.5, 0.5)]
    sides = [(i % 3, s, rng.randrange(5), rng.choice((1, 2, 3, 4, 5, None)), low, low + 0.1) for s in ("original", "translated") for i in range(60) for low in (rng.randrange(9) / 10,)]
    rows = sides + sides[::7] + [(2, "original", 1, 9, 0.3, 0.4)] * 3
    c = spark.createDataFrame(captions, "pair_id long, name string, original_page int, translated_page int, original_fraction double, translated_fraction double")
    r = spark.createDataFrame(rows, "pair_id long, side string, page int, signature int, start double, end double")
    want = {}
    for p, name, op, tp, of, tf in captions:
        near = lambda s, page, at: [x[3] for x in rows if x[0] == p and x[1] == s and x[2] == page and at is not None and x[4] - 0.065 <= at <= x[5] + 0.065 and x[3] is not None]
        want.setdefault((p, name), []).extend(a for a in near("original", op, of) for b in near("translated", tp, tf) if a == b)
    want = {k: v[0] for k, v in want.items() if len(v) == 1}
    got = align.match_regions(c, r).collect()
    assert {(x["pair_id"], x["name"]): x["signature"] for x in got} == want and len(got) == len(want) > 10
    # 20,000 captions of one place, 20,000 like regions on each side: 4 * 10^8 pairs would not end
    many = spark.range(20000).selectExpr("0L pair_id", "concat('n', id) name", "7 original_page", "7 translated_page", "0.5D original_fraction", "0.5D translated_fraction")
    like = spark.range(20000).selectExpr("0L pair_id", "explode(array('original', 'translated')) side", "7 page", "if(side = 'original', 1, 2) signature", "0.4D start", "0.6D end")
    one = spark.createDataFrame([(0, s, 7, 3, 0.4, 0.6) for s in ("original", "translated")], "pair_id long, side string, page int, signature int, start double, end double")
    found = align.match_regions(many, like.unionByName(one))
    assert found.agg(F.count("*"), F.min("signature"), F.max("signature")).first() == (20000, 3, 3)


def test_no_side_of_bins_on_the_driver(spark):
    a = spark.range(9).selectExpr("1 k", "cast(id as double) a", "cast(id as double) b")
    joined = intervals.overlapping(a, a.toDF("k", "c", "d"), ["k"], ("a", "b"), ("c", "d"), 1.0)
    assert joined.count() == 9
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
