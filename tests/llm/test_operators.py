"""Each operator against brute force, and on nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import textkernel
from llm import classifier, decontaminate, lm_scoring, mixing, ngram_join, quality_rules, substring_dedup, token_files, url_filter, warc

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, _mix string, _salt int, key long"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "Tu", "é") for b in ("n", "rs", "t.", "ba", "x,")]
    docs = [" ".join(rng.choices(words, k=rng.choice((3, 25, 80, 200)))) for _ in range(n)]
    base = [f"{w}{i}" for i, w in enumerate(rng.choices(words, k=150))]
    for _ in range(45):  # near copies, more than a heavy list holds
        copy = list(base)
        for _ in range(rng.choice((1, 3, 6, 9))):
            copy[rng.randrange(150)] = f"new{rng.random()}"
        docs.append(" ".join(copy))
    docs = [d + " end." for d in docs]
    docs += [docs[0], docs[0], "", None, " \n\t ", "one", "two words", "\u3000 wide", docs[5] + "\n" + docs[6]]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", f"src{i % 4}" if i % 5 else None, 0, "m", 1, 2) for i, t in enumerate(corpus())]
    rows += [(None, "a null id of a row", None, None, None, None, None, None), rows[7], rows[7], (1, rows[8][1], None, "zz", None, None, None, None)]
    return spark.createDataFrame(rows, SHAPE).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def low(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def test_ngram_join(docs, empty):
    got = {(r[0], r[1], r[2]) for r in ngram_join.jaccard_components(docs, 4, 85, 100).collect()}
    rows = [(r["doc_id"], low((r["text"] or "").encode()).split()) for r in docs.collect()]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()) for _, w in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    want = set()
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        want.add((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    assert got == want
    small = {(r[0], r[1], r[2]) for r in ngram_join.jaccard_components(docs, 4, 85, 100, cell=7, order_bits=600).collect()}
    assert small == want
    assert ngram_join.jaccard_components(empty, 4, 85, 100).count() == 0
    kept = ngram_join.deduplicate(docs, 4, 85, 100)
    assert kept.columns == docs.columns
    groups = {}
    for (doc, _), s, g in zip(rows, sets, label):
        if s:
            groups.setdefault(g, []).append((doc is None, doc or 0, s, doc))
    left = kept.collect()
    assert len(left) == len(groups) + sum(not s for s in sets)
    ids = Counter(r["doc_id"] for r in left if (r["text"] or "").split())
    assert ids == Counter(min(g, key=lambda x: x[:2])[3] for g in groups.values())
    assert ngram_join.deduplicate(empty).count() == 0


def test_ngram_orders():
    """Every order ranks rare shingles first, and linked sets share a prefix shingle under each."""
    rng = np.random.default_rng(3)
    x = np.unique(ngram_join.mix(rng.integers(0, 2**40, 4000).astype(np.uint64)))
    count = rng.integers(1, 300, len(x))
    n = 4
    bucket = ngram_join.bucket_of(x, n)
    rows = []
    for b in range(n):
        base, blob = ngram_join._frequency_segment(x[bucket == b] & ngram_join._LOW, count[bucket == b], 1 << 20)
        rows.append({"bucket": b, "n": base, "blob": blob})
    orders = ngram_join.ShingleOrders(rows, n)
    level, lone = orders.levels(x)
    assert (level >= np.floor(np.log2(count))).all() and (level == np.floor(np.log2(count))).mean() > 0.8
    assert not lone[count > 1].any() and lone[count == 1].mean() > 0.8
    for num, den in ((85, 100), (4, 5)):
        bounds = ngram_join.size_classes(num, den)
        for _ in range(200):
            s = np.sort(rng.choice(x[count > 1], 120, replace=False))
            t = np.sort(np.concatenate((rng.permutation(s)[: 120 - rng.integers(0, 8)], rng.choice(x[count > 1], 4, replace=False))))
            t = np.unique(t)
            both = len(np.intersect1d(s, t))
            if den * both < num * (len(s) + len(t) - both):
                continue
            for a, z in zip(*(orders.prefixes(u, *orders.levels(u), ngram_join.prefix_length(len(u), num, den)) for u in (s, t))):
                assert len(np.intersect1d(a, z))
            assert abs(int(np.searchsorted(bounds, len(s), side="right")) - int(np.searchsorted(bounds, len(t), side="right"))) <= 1


def test_substring_dedup(docs, empty):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(substring_dedup.remove_repeats(docs)).collect())
    rows = [(-(2**63) if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode().split()) for r in docs.collect()]
    first = {}
    for d, w in rows:
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            first[k] = min(first.get(k, (d, s)), (d, s))
    want = Counter()
    for d, w in rows:
        gone = {j for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (d, s) for j in range(s, s + 20)}
        left = [x for j, x in enumerate(w) if j not in gone]
        want[(None if d == -(2**63) else d, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest())] += 1
    assert got == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_hot_minimisers(docs, monkeypatch):
    """Windows of hot minimisers, sent one by one, give the same words."""
    whole = Counter(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup, "LEAST_HOT", 0)
    monkeypatch.setattr(substring_dedup, "HOT", -1)
    assert Counter(map(tuple, substring_dedup.remove_repeats(docs).collect())) == whole


def test_lm_scoring(docs, empty):
    rows = [(r["doc_id"], low((r["text"] or "").encode()).split() + [None]) for r in docs.collect()]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    count = Counter(w for d, ws in rows if not held(d) for w in ws)
    total, below = sum(count.values()), math.log10(sum(count.values()) + 0.1 * (len(count) + 1))
    want = sorted((str(d), held(d), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10(count[x] + 0.1) - below for x in w), 6)) for d, w in rows)
    got = lm_scoring.score(docs).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_scoring.score(empty).count() == 0


def test_log_frequency_levels():
    keys = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.random.default_rng(1).integers(1, 500, len(keys))
    f = lm_scoring.LogFrequencyFilter({0: lm_scoring._fill(keys, counts, 1 << 20)}, 1)
    level = f.level(keys, np.zeros(len(keys), np.int64))
    assert (level >= lm_scoring.levels(counts)).all() and (level == lm_scoring.levels(counts)).mean() > 0.98


def lm_rows(docs, least_pair):
    """(doc_id, tokens, score) by brute force, from counts at the middle of their levels."""
    rows = [(r["doc_id"], low((r["text"] or "").encode()).split() + [None]) for r in docs.collect()]
    train = [w for d, w in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 10]
    count = Counter(x for w in train for x in w)
    two = Counter(x for w in train for x in zip([None, *w], w))
    near = lambda c: float(lm_scoring._BETWEEN[lm_scoring.levels(np.array([c]))[0]]) if c else 0.0
    below = sum(count.values()) + 0.1 * (len(count) + 1)
    out = []
    for d, w in rows:
        given = [min(1, near(two[x] if two[x] >= least_pair else 0) / max(near(count[x[0]]), 1)) for x in zip([None, *w], w)]
        out.append((d, len(w), sum(math.log10(0.9 * (near(count[x]) + 0.1) / below + 0.1 * g) for x, g in zip(w, given))))
    return out


def assert_lm_scores(docs, least_pair):
    want = sorted(lm_rows(docs, least_pair), key=str)
    got = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in lm_scoring.score(docs).collect()), key=str)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    off = [abs(g[2] - w[2]) / w[1] for g, w in zip(got, want)]  # a false positive of the filter moves one token
    assert np.mean(off) < 0.01 and np.mean(np.array(off) < 1e-9) > 0.3


def test_lm_filter_holds_all(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "MAX_BITS", 1 << 10, raising=False)
    assert_lm_scores(docs, getattr(lm_scoring, "MIN_PAIR", 1))


def test_lm_filter_holds_pairs_seen_once(docs):
    assert_lm_scores(docs, 1)


def test_decontaminate(spark, docs, empty):
    texts = [t for t in corpus() if t]
    items = spark.createDataFrame([(1, texts[2]), (2, " ".join(texts[3].split()[:30]) + " other words here"), (3, "two WORDS"), (4, None), (None, texts[70]), (5, "not there at all in any of them")], "item_id long, text string")
    words = lambda t: low((t or "").encode()).split()
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = Counter()
    for d in docs.collect():
        for i in items.collect():
            w = words(i["text"])
            s = grams(w, min(5, len(w))) if w else set()
            both = len(s & grams(words(d["text"]), min(5, len(w) or 1)))
            if s and 5 * both >= 4 * len(s):
                want[(d["doc_id"], i["item_id"], both, len(s))] += 1
    assert Counter(map(tuple, decontaminate.leaks(docs, items).collect())) == want and want
    assert decontaminate.clean(docs, items).count() == docs.count() - len([1 for d in docs.collect() if any(k[0] == d["doc_id"] for k in want)])
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def quality_twin(t):
    """(kept lines, lost words, kept) of a text by the rules as the module states them, on strings."""
    w = words_of(t)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, lost, seen = [], 0, set()
    for line in t.split("\n"):
        here = words_of(line)
        if not here:
            lines.append(line)
            continue
        last = here[-1]
        while last and last[-1] in "\"')]}*_”’»":
            last = last[:-1]
        bars = line.count(" | ") + line.count(" > ")
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
        fails = (
            line in seen
            or last[-1:] not in tuple(".!?:;…。！？")
            or (len(here) > 1 and sum(x[-2:] in ("!!", "??", "!?", "?!") for x in here) >= len(here) / 2)
            or sum(c in "#*$%&|<>" for c in line) > 0.1 * len(line.encode())
            or (bars >= 2 and 4 * bars >= len(here))
            or (len(here) >= 4 and sum(a == b for a, b in zip(here, here[1:])) >= len(here) / 2)
            or any(p.decode() in small for p in quality_rules.PHRASES)
        )
        seen.add(line)
        if fails:
            lost += len(here)
        else:
            lines.append(line)
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return lines, lost, not failed and lost <= 0.5 * len(w), len(rep), failed


def test_quality_rules(spark, docs, empty):
    rng = random.Random(8)
    base = corpus()
    marks = [".", "!", "", '."', "?)", "!!", "…", ".»", "x", ".\u2000", "。"]
    made = []
    for _ in range(300):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            ws = words_of(rng.choice(base[:40]))[: rng.randrange(1, 30)]
            kind = rng.randrange(9)
            if kind == 0:
                ws = [x + rng.choice(("!!", "??")) for x in ws]
            elif kind == 1:
                ws = [y for x in ws for y in (x, rng.choice(("|", ">")))]
            elif kind == 2:
                ws = [ws[0]] * len(ws)
            elif kind == 3:
                ws = [x + rng.choice(("", "%%%", "$$$")) for x in ws]
            elif kind == 4:
                ws += ["Tous", "droits", "réservés"] if rng.random() < 0.5 else ["Read", "MORE"]
            lines.append(rng.choice(("", " ")) + " ".join(ws) + rng.choice(marks) + rng.choice(("", " ", "\r")))
        lines += rng.sample(lines, rng.randrange(0, 2))
        made.append("\n".join(lines))
    long = "\n".join(f"A sentence of number {i} that nothing else repeats, with é in it." for i in range(14_000))  # above a window of the word scanner
    rows = [(i, t) for i, t in enumerate([*made, long, made[0], None, ""])] + [(0, made[0]), (None, made[1])]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, n_chars int").repartition(3)
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"], r["n_lost_words"]) for r in quality_rules.report(table).collect())
    want, texts = Counter(), Counter()
    for i, t in rows:
        t = t or ""
        w, lines = words_of(t), [x for x in t.split("\n") if words_of(x)]
        left, lost, kept, rep, failed = quality_twin(t)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, failed, kept, lost)] += 1
        if kept:
            texts[(i, "\n".join(left), len("\n".join(left)))] += 1
    assert got == want and 20 < sum(k[-2] for k in want) < len(want) - 20
    cleaned = quality_rules.clean(table)
    assert cleaned.columns == table.columns and Counter((r["doc_id"], r["text"], r["n_chars"]) for r in cleaned.collect()) == texts
    assert quality_rules.clean(docs).columns == docs.columns
    assert quality_rules.report(empty).count() == 0 and quality_rules.clean(empty).count() == 0


def test_warc(spark):
    rows = [(1, "http://a.b/c", "x" * 100_000), (2, None, "x" * 100_000), (3, "http://q\r\nX: y", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 5000), (None, "u", "only"), (6, "u", "one"), (6, "u", "one")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha string")
    got = warc.round_trip(pages, segment_bytes=5000).collect()
    assert not [r for r in got if r["problem"]]
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw, keep = (h or "").encode(), best[h or ""]
        alone = i == keep or keep == -1
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if alone else "revisit", None if alone else keep))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_streams():
    """Files are parsed piece by piece, in gzip members or plain, cut off or not."""
    import gzip

    want = [r for i in range(40) for r in warc.records(i, "u", bytes([65 + i % 26]) * (i * 9000), None, 1 << 20)]
    plain = b"\r\n\r\n".join(want) + b"\r\n\r\n"
    members = b"".join(gzip.compress(r + b"\r\n\r\n") for r in want)
    for content in (plain, gzip.compress(plain), members):
        got = list(warc._parse(content))
        assert [int(f["x-page-id"]) for f, _ in got] == list(range(40))
        assert all(warc._finish(b, "response", f["warc-payload-digest"].removeprefix("sha1:"), None)[1] is None for f, b in got)
    assert len(list(warc._parse(plain[: len(plain) // 2]))) < 40 and list(warc._parse(b"")) == []


def test_warc_damage():
    records = [r for r in warc.records(7, "u", b"payload " * 5000, None, 9000)]
    parts = []
    for f, block in warc._parse(b"\r\n\r\n".join(records)):
        n = lambda k: int(f[k]) if k in f else None
        parts.append({"number": n("warc-segment-number"), "total": n("warc-segment-total-length"), "page_id": n("x-page-id"), "url": None, "record_type": f["warc-type"], "refers_to": None, "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "block": block})
    assert warc.reassemble(parts)[5:] == (b"payload " * 5000, None)
    assert "missing" in warc.reassemble(parts[:1] + parts[2:])[6] and "no last" in warc.reassemble(parts[:-1])[6] and "no first" in warc.reassemble(parts[1:])[6]
    parts[-1]["total"] += 1
    assert "length" in warc.reassemble(parts)[6]
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nab")


def parse_url(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (low(found[1].encode()).decode(), found[2]) if found else ("", "")


def test_url_filter(spark):
    rng = random.Random(5)
    urls = [f"http{'s' * (i % 2)}://{rng.choice(['www.', '', 'a.b.'])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'NET', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{i % 90}{rng.choice(['', '?q=/en/', '#x'])}" for i in range(800)]
    urls += [None, "", "no scheme/en/", "http://", "http://com/en/", "http://xcom/en/", "x://com?/en/"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(4)
    for r in url_filter.judge(pages).collect():
        host, path = parse_url(urls[r["page_id"]])
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *(max(fit)[1:] if fit else (None, "allow")))
    many = tuple((f"h{i}.com", "/", "block") for i in range(300))
    some = spark.createDataFrame([(i, f"http://h{i}.com/") for i in range(3000)], "page_id long, url string")
    assert {r["page_id"] for r in url_filter.judge(some, many).collect() if r["verdict"] == "block"} == set(range(300))
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, (), "block").collect()} == {"block"}
    twice = url_filter.judge(pages.union(pages)).collect()
    assert Counter(map(tuple, twice)) == Counter({tuple(r): 2 for r in url_filter.judge(pages).collect()})
    with pytest.raises(ValueError):
        url_filter.judge(pages, (("a", "/", "allow"), ("a", "/", "block")))


def test_url_cascade_levels(spark):
    """A level that errs on far more keys than are listed still ends in exact membership."""
    universe = spark.range(60_000).select(F.xxhash64("id").alias("key"))
    listed = np.array([r[0] for r in universe.limit(500).collect()], np.int64).view(np.uint64)
    cascade = url_filter._build(universe, 1, np.sort(listed))  # told of one key, level 0 takes half of them
    every = np.array([r[0] for r in universe.collect()], np.int64).view(np.uint64)
    assert len(cascade.levels) > 3 and (cascade.has(every) == np.isin(every, listed)).all()


def test_classifier(spark, empty):
    rng = random.Random(2)
    good = [" ".join(rng.choices(["plain", "words", "of", "text", "here", "and"], k=40)) for _ in range(150)]
    junk = [" ".join(rng.choices(["$$$", "buy", "###", "now", "|"], k=40)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + junk)] + [(None, None, "x"), (900, "", "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = classifier.score(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert held and all(r["predicted"] == int(r["doc_id"] < 150) for r in held)
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in classifier.score(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.score(empty, labels).count() == 0


def features_twin(text):
    """Feature buckets of a text, found word by word and character by character."""
    def run(raw):
        acc = np.zeros(1, np.uint64)
        for i, b in enumerate(raw):
            acc += textkernel._TABLES[False][b] * textkernel._UP[i : i + 1]
        return acc

    mask, out, words = np.uint64(classifier.BUCKETS - 1), Counter(), words_of(text)
    for w in words:
        raw = w.encode()
        out[int((textkernel.mix(textkernel.mix(run(raw) + np.uint64(len(raw)))) & mask)[0])] += 1
        for g in classifier.GRAMS:
            for i in range(len(w) - g + 1):
                out[int((textkernel.mix(run(w[i : i + g].encode()) + np.uint64(g << 8)) & mask)[0])] += 1
    out[classifier.AGAIN] += sum(a == b for a, b in zip(words, words[1:]))
    return out


def test_classifier_against_brute_force(spark, monkeypatch):
    """Features of characters, scores from the weights one feature at a time, and the bounds of the sample."""
    import pyarrow as pa

    texts = ["éa b\u2028c ñ😀x", "go go go été", "", None, "one\ntwo  été", "\u3000 wide", "a" * 50]
    row, bucket = classifier.document_features(pa.array(texts))
    for i, t in enumerate(texts):
        assert +Counter(bucket[row == i].tolist()) == +features_twin(t or "")
    monkeypatch.setattr(classifier, "_WINDOW", 64)  # texts of many windows
    row, bucket = classifier.document_features(pa.array([" ".join(filter(None, texts)) * 4]))
    assert +Counter(bucket.tolist()) == +features_twin(" ".join(filter(None, texts)) * 4)
    monkeypatch.undo()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, "go go go été"), (None, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 2, "doc_id long, quality int")
    weight, bias = classifier.fit(docs, labels)
    for r in classifier.score(docs, labels).collect():
        t = dict(enumerate(texts)).get(r["doc_id"], "x y") or ""
        f = features_twin(t)
        odds = sum(float(weight[b]) * n for b, n in f.items()) / max(1, sum(f.values())) + bias
        assert abs(r["score"] - 1 / (1 + math.exp(-odds))) < 1e-6 and r["predicted"] == int(r["score"] >= classifier.THRESHOLD)
    seen = []
    monkeypatch.setattr(classifier, "train", lambda texts, labels: seen.append(texts) or (np.zeros(classifier.BUCKETS, np.float32), 0.0))
    classifier.fit(docs, labels, 5)
    classifier.fit(docs, labels, 100, 20)
    assert len(seen[0]) == 5 and sum(len(t.encode()) for t in seen[1]) <= 20 and seen[1]


def test_classifier_held_out(spark):
    """Held-out accuracy on the smallest table."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    got = {r["doc_id"]: r for r in classifier.score(read("documents"), read("labels")).collect()}
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in read("labels").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    good, bad = ([s for s, q in held if q == x] for x in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert len(held) > 50 and auc > 0.95


def test_token_files(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    blob = lambda ids: b"\x02" + np.array(ids, "<u2").tobytes()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(blob(r[1])), blob(r[1])))
    at, want = 0, []
    for d, ids in rows:
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.digest(token_files.round_trip(docs, path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_files.round_trip(empty, path).count() == 0


def test_full_word_cache(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    monkeypatch.setattr(token_files, "CACHE_WORDS", 20)
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for t in corpus()]
    for i in range(0, len(texts), 3):
        ids, at = encoder.encode(pa.array(texts[i : i + 3]))
        want = [e.ids + [2] for e in encoder.tokenizer.encode_batch(texts[i : i + 3], add_special_tokens=False)]
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == want


def test_huffman_codes():
    rng = np.random.default_rng(4)
    for counts in ([(7, 1)], [(1, 5), (9, 5)], [(i, int(x)) for i, x in enumerate(2 ** np.arange(30))], [(i, int(x)) for i, x in enumerate(rng.integers(1, 1000, 700))]):
        lengths = token_files.code_lengths(counts, 12)
        assert max(lengths.values()) <= 12 and sum(Fraction(1, 2**n) for n in lengths.values()) <= 1
        codes = token_files.Codes(lengths)
        ids = rng.choice([c[0] for c in counts], 3000)
        payload, bits, checks = codes.pack(ids)
        assert (codes.unpack(payload, len(ids), checks, token_files.STEP) == ids).all()


def test_mixing(docs, empty):
    weights = {"src0": 5, "src1": 1, "src2": 3, "src3": 2}
    rows = mixing.place(docs, weights, 1, 4).select("doc_id", "_mix.*").collect()
    assert len(rows) == docs.count()
    blocks = {(r["stream"], r["block"]): r for r in rows}
    for r in blocks.values():
        assert r["release"] <= r["slot"] < r["deadline"]
    assert len({r["slot"] for r in blocks.values()}) == len(blocks)
    all_weights, total = {**weights, mixing.OTHER: 1}, 12
    slots = mixing.schedule(all_weights)
    for t in range(1, total + 1):
        for s, a in all_weights.items():
            assert abs(sum(x < t for x in slots[s]) - Fraction(a * t, total)) < 1
    assert mixing.mixed(docs, weights).columns == docs.columns and mixing.place(empty).count() == 0
    assert sum(mixing.integer_weights({"a": 0.7, "b": 0.299, "c": 0.001}).values()) == 1000


def test_long_texts(spark):
    """Texts above 512 KB, where the word scanner works in windows: no operator cuts them or loses their ends."""
    import pyarrow as pa

    rng = random.Random(12)
    ws = [f"w{rng.randrange(10**6)}{rng.choice(('', '.', 'é'))}" for _ in range(100_000)]
    other = [*ws[:-30], *(f"new{i}" for i in range(30))]
    texts = ["\n".join(" ".join(ws[i : i + 15]) for i in range(0, len(ws), 15)), " ".join(other), " ".join(ws[-60:-5]), "x" * 700_000 + " end"]
    assert len(texts[0].encode()) > 1 << 19
    data, offs = textkernel.text_bytes(pa.array(texts))
    starts, ends, h, at = textkernel.scan_words(data, offs)
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(starts[:100_000].tolist(), ends[:100_000].tolist())] == [w.encode() for w in ws] and at.tolist() == [0, 100_000, 200_000, 200_055, 200_057]
    for i in (0, 50_000, 74_999, 99_999):
        assert textkernel.scan_words(np.frombuffer(ws[i].encode(), np.uint8), np.array([0, len(ws[i].encode())]))[2][0] == h[i]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, 4, 85, 100).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert removed == {0: (100_000, 0), 1: (100_000, 99_970), 2: (55, 55), 3: (2, 0)}
    items = spark.createDataFrame([(7, " ".join(ws[-25:]))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.leaks(docs, items).collect()] == [(0, 7, 21, 21)]
    assert {r["doc_id"]: r["n_tokens"] for r in lm_scoring.score(docs).collect()} == {0: 100_001, 1: 100_001, 2: 56, 3: 3}
    row, _ = classifier.document_features(pa.array(texts))
    grams = lambda t: sum(max(0, len(w) - g + 1) for w in words_of(t) for g in classifier.GRAMS)
    again = lambda t: sum(a == b for a, b in zip(words_of(t), words_of(t)[1:]))
    assert np.bincount(row).tolist() == [len(words_of(t)) + again(t) + grams(t) for t in texts]


def test_long_texts_in_token_files(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(13)
    texts = [" ".join(f"Word{rng.randrange(5000)}," for _ in range(90_000)), "short", " ".join(f"é{rng.randrange(50)}" for _ in range(150_000))]
    docs = spark.createDataFrame([(9 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tok, at, want = Tokenizer.from_file(path), 0, []
    for i in (2, 1, 0):
        ids = tok.encode(texts[i], add_special_tokens=False).ids + [2]
        want.append((9 - i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.digest(token_files.round_trip(docs, path)).collect())) == sorted(want)


def test_decontaminate_blocks(spark, docs, empty, monkeypatch):
    """Items in several blocks, each a pass of its own, give what one block gives; empty tables and odd names too."""
    items = spark.createDataFrame([(i, " ".join(t.split()[:40])) for i, t in enumerate(corpus()[:8])], "item_id long, text string")
    want = Counter(map(tuple, decontaminate.leaks(docs, items).collect()))
    kept = Counter(r["doc_id"] for r in decontaminate.clean(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    assert len(list(decontaminate._blocks(items))) > 2
    assert Counter(map(tuple, decontaminate.leaks(docs, items).collect())) == want and want
    assert Counter(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == kept
    assert decontaminate.clean(empty, items).count() == 0 and decontaminate.clean(empty, items).columns == empty.columns


def pipeline_rows(rows, items, encode):
    """The pipeline by brute force: lists of (doc_id, text, source) and of item texts."""
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    lower = lambda t: [low(w.encode()) for w in words_of(t)]
    kept = []
    for d, t, s in rows:
        lines, _, stays, *_ = quality_twin(t or "")
        if stays:
            kept.append((d, "\n".join(lines), s))
    sets = [grams(x, 5) if len(x) >= 5 else {tuple(x)} if x else set() for x in (lower(t) for _, t, _ in kept)]
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    first = {}
    for r, g, s in zip(kept, label, sets):
        if s:
            first[g] = min(first.get(g, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    kept = [r for r, g, s in zip(kept, label, sets) if not s or r is first[g]]
    tests = [(grams(w, min(5, len(w))), min(5, len(w))) for w in map(lower, items) if w]
    kept = [r for r in kept if not any(5 * len(s & grams(lower(r[1]), k)) >= 4 * len(s) for s, k in tests)]
    weights = {**mixing.WEIGHTS, mixing.OTHER: 1}
    slots = mixing.schedule(weights)
    order = []
    for stream, a in weights.items():
        own = [r for r in kept if (r[2] if r[2] in mixing.WEIGHTS else mixing.OTHER) == stream]
        own.sort(key=lambda r: (hashlib.md5((mixing.SEED + ("" if r[0] is None else str(r[0]))).encode()).hexdigest(), r[0] or 0))
        for i, r in enumerate(own):
            b = i // mixing.BLOCK_ROWS
            order.append((b // a * sum(weights.values()) + slots[stream][b % a], i % mixing.BLOCK_ROWS, r))
    out, at = [], 0
    for *_, (d, t, _) in sorted(order, key=lambda x: x[:2]):
        ids = encode(t) + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_pipeline(spark, docs, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    lines = corpus()[5].split()
    rows.append((1000, "\n".join([" ".join(lines), "Home", "click here to read more", " ".join(lines[:4]) + " end"] * 2), "src1"))
    path = str(tmp_path / "sf")
    spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(path + "/documents.parquet")
    items = [corpus()[1], corpus()[3]]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    want = pipeline_rows(rows, items, lambda t: tok.encode(t, add_special_tokens=False).ids)
    got = sorted(map(tuple, p.run(spark, path).collect()), key=lambda r: r[1])
    assert got == want and len(want) > 20
    assert [s[0] for s in p.STAGES][0] == "quality rules"
