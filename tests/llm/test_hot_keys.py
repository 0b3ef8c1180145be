"""Values that most items share, hosts of very many labels."""

import random
import time

import numpy as np
import pyarrow as pa

from llm import common, decontaminate, ngram_join, url_filter


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_items_of_one_template_against_texts_that_repeat_it(monkeypatch):
    rng = random.Random(1)
    opening = words(rng, 14)
    items = [(i, " ".join(opening + words(rng, 36))) for i in range(20_000)]
    index = decontaminate.ItemIndex(items, 5, 4, 5)
    leak = items[777][1]
    texts = [" ".join(opening * 150 + words(rng, 30)) for _ in range(20)] + ["so " + leak + " end", " ".join(leak.split()[:44]), " ".join(leak.split()[14:]), None, ""]
    began = time.time()
    found = sorted(index.find(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])))
    assert [(r, o) for r, o, *_ in found] == [(20, 777), (21, 777)] and time.time() - began < 20


def test_slices_of_owners_give_the_same_candidates(monkeypatch):
    rng = random.Random(2)
    opening = words(rng, 30)
    items = [(i, " ".join(opening + words(rng, 3) if i % 3 else words(rng, 20))) for i in range(300)]
    texts = [items[rng.randrange(300)][1] + " " + " ".join(words(rng, 5)) for _ in range(40)] + [" ".join(opening)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    index = decontaminate.ItemIndex(items, 5, 4, 5)
    whole = sorted(index.find(batch))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = [(i, grams(t)) for i, t in items]
    want = sorted((r, i, len(s & g), len(s)) for r, g in enumerate(map(grams, texts)) for i, s in sets if 5 * len(s & g) >= 4 * len(s))
    assert whole == want and len(whole) > 3000
    for size in (1, 50, 1000):
        monkeypatch.setattr(decontaminate, "SLICE", size)
        assert sorted(index.find(batch)) == want


def test_hosts_of_very_many_labels(spark):
    long = "a." * 100_000 + "example.net"
    rows = [(1, f"http://{long}/de/81"), (2, f"http://{long}/de/7"), (3, "http://com/en/"), (4, "http://x.com/en/1"), (5, "http://net"), (6, "http://.com/en/"), (7, "http://com./en/"), (8, f"x://{'.' * 1000}org/es/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("example.net/de/8", "block"), 2: ("net/de/", "allow"), 3: ("com/en/", "block"), 4: ("com/en/", "block"), 5: (None, "allow"), 6: ("com/en/", "block"), 7: (None, "allow"), 8: ("org/es/", "block")}
    assert np.array(list(got)).size == 8


def test_copies_for_salts_are_not_broadcast(spark):
    big = spark.range(300).selectExpr("id % 3 as k", "id as v")
    small = spark.range(2).selectExpr("id as k", "id * 10 as w")
    for how, rows in (("left", 300), ("inner", 200)):
        joined = common.salted_join(big, small, "k", how)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        got = {r["v"]: r["w"] for r in joined.collect()}
        assert len(got) == rows and all(w == (None if v % 3 == 2 else v % 3 * 10) for v, w in got.items())


def test_full_order_filter_still_tells_lone_shingles():
    x = np.random.default_rng(1).integers(0, 1 << 32, 9000, np.uint64)  # one bucket of one: the high half is 0
    shared, lone = x[:1000], x[1000:]
    base, blob = ngram_join._frequency_segment(shared, np.full(1000, 2), 1024)
    orders = ngram_join.ShingleOrders([{"bucket": 0, "n": base, "blob": blob}], 1)
    assert len(blob) <= 128
    level, once = orders.levels(shared)
    assert (level >= 1).all() and not once.any()
    assert 0.25 < orders.levels(lone)[1].mean() < 0.5
    assert orders.prefixes(lone[:400], *(v[:400] for v in orders.levels(lone)), ngram_join.prefix_length(400, 85, 100)) == []
