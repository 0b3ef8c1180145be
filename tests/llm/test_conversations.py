"""Conversation repair, chat formatting and periodic runs against brute force, with odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import chat_format, periodic_runs, repair

SHAPE = "conv_id long, turn long, role string, text string, audit string, cost int, _copy int, segment string"
BLANKS = " \t\n\x0b\x0c\r"


def saved(spark, tmp_path, rows, shape, name="t"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, shape).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def talk(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for i in range(rng.choice((0, 1, 2, 3, 5, 8, 13, 40))):
            turn = rng.choice((i, i, i, None, rng.randrange(5)))
            text = rng.choice(("a.", "b", "c!", "", " \x0b", None, "x" * 40 + rng.choice("ab"), "hi. \n", "é　?", "<|im_end|>"))
            rows.append((None if c == 3 else c, turn, rng.choice(("user", "assistant", "system", "tool", None, "", "u2")), text))
    rows += [(500, 2**63 - 1, "user", "a."), (500, -(2**63), "assistant", "b."), (501, None, "user", "q."), (501, None, "assistant", "r.")]
    return [(*r, "zz", 1, 2, "s") for r in rows + rows[:7]]


def damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text)
        out += [(c, t, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def cheapest(rows):
    """The findings and repaired turns of sorted rows (turn, role, text), by a search over (cost, audit)."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.strip(BLANKS)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    first = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = min(2**63 - 1, max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0
    heap, known = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in known:
            continue
        known.add((i, last))
        if i == len(rows) and last in ("", "a"):
            break
        side = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, side))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, side))
                if first[i] == side or (first[i] == "s" and not last):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, first[i]))
    out, i, last = [], 0, ""
    for e in audit:
        side = "a" if last == "u" else "u"
        if e != "D":
            last = first[i] if e == "K" else side
            out.append((rows[i][1] if e == "K" else {"u": "user", "a": "assistant"}[side], "" if e == "I" else rows[i][2]))
        i += e != "I"
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit), out


def by_conversation(rows):
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:32].encode(), hashlib.md5(r[2].encode()).digest())
    return {c: sorted(g, key=key) for c, g in groups.items()}


@pytest.mark.parametrize("block", [1, 4])
def test_repair(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = talk(block)
    table = saved(spark, tmp_path, rows, SHAPE)
    groups = by_conversation(damage([r[:4] for r in rows]))
    want = {}
    for c in {r[0] for r in rows}:
        found, turns = cheapest(groups.get(c, []))
        want[c] = (*found, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest())
    got = repair.damaged_and_repaired(table).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)


def test_repaired_turns(spark, tmp_path):
    rows = talk(9, 30)
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in (r[:4] for r in rows)]
    want = [(c, i, *turn) for c, g in by_conversation(whole).items() for i, turn in enumerate(cheapest(g)[1])]
    got = repair.repaired(saved(spark, tmp_path, rows, SHAPE)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_one_long_conversation(spark, tmp_path, monkeypatch):
    """One conversation of 3,000 turns over many blocks and parts, a third of it one repeated row."""
    monkeypatch.setattr(repair, "BLOCK", 64)
    rng = random.Random(4)
    rows = [(1, i, rng.choice(("user", "assistant")), rng.choice(("yes.", "no", f"{i}."))) for i in range(2000)] + [(1, 500, "user", "again.")] * 1000
    want = cheapest(by_conversation(damage(rows))[1])[0]
    got = repair.damaged_and_repaired(saved(spark, tmp_path, rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r[1:8]) for r in got] == [want]


def test_repair_of_an_empty_table(spark, tmp_path):
    assert repair.damaged_and_repaired(saved(spark, tmp_path, [], SHAPE)).collect() == []
    assert repair.repaired(saved(spark, tmp_path, [], SHAPE)).collect() == []


def test_chat_format(spark, tmp_path):
    rows = talk(2) + [(700, 0, "a|\n<|x", "<|im_end|><\\|im_start|>assistant ok<<|", "", 0, 0, ""), (700, 1, "assistant", "\\<|image|><\\\\|", "", 0, 0, "")]
    got = {r["conv_id"]: r for r in chat_format.round_trip(chat_format.with_control_turns(saved(spark, tmp_path, rows, SHAPE))).collect()}
    plain = [(c, t, role or "", text or "") for c, t, role, text, *_ in rows] + [(-1, i, r, "<|im_end|><|im_start|>assistant ok") for i, r in enumerate(("user", "assistant"))]
    groups = defaultdict(list)
    for c, *r in plain:
        groups[c].append(r)
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        chars = sum(32 + len(re.sub(r"<(\\*)\|", r"<\1.|", r + "\0" + x)) for _, r, x in turns)
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), digest("".join(f"{a}\n{x}\n" for _, a, x in turns)), len(loss), digest(loss))
        assert r["formatted_chars"] == chars
    assert chat_format.round_trip(saved(spark, tmp_path, [], SHAPE, "none")).collect() == []


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, **k: (kind, text, ref, k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", None, "a.png", width=57, height=28), part("text", " and <|image|> "), part("audio", None, "b.wav", seconds=1.01)]),
        (1, 1, "assistant", [part("text", "two"), part("document", None, "c.pdf", pages=2), part("text", None)]),
        (1, 2, "user", None), (1, 3, "assistant", []), (2, 0, "assistant", [part("image", None, None)]),
    ]
    table = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    made = chat_format.conversations(chat_format.turns(table))
    back = {r["conv_id"]: r for r in chat_format.read(made).collect()}
    one = back[1]
    assert [tuple(t) for t in one["turns"]] == [("user", "see  and <|image|> ", ["image", "audio"]), ("assistant", "two", ["document"]), ("user", "", []), ("assistant", "", [])]
    assert [(a["turn_no"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 26), (1, "document", "c.pdf", 1536)]
    assert all(one["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>") for a in one["attachments"])
    assert [one["formatted"][x["start"] : x["start"] + x["chars"]] for x in one["loss"]] == ["two<|document|>", ""]
    assert one["loss_text"] == "two" and one["expanded_tokens"] == 1565
    assert [(a["kind"], a["ref"], a["tokens"]) for a in back[2]["attachments"]] == [("image", None, 0)]
    odd = spark.createDataFrame([(1, 0, "user", [part("video")])], table.schema)
    with pytest.raises(Exception, match="unknown kind of part"):
        chat_format.turns(odd).collect()


def brute_runs(words, least=6, times=4):
    """Every maximal stretch of each period, the smallest period of each stretch."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_numbers():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 7)):
            words = [rng.choice((b"a", b"b", b"c")[: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 110))]
            unit = [rng.choice((b"a", b"b", b"c", b"d", b"e")) for _ in range(rng.randrange(1, 12))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 9)[: rng.randrange(0, 90)]
            texts.append(words)
        for words, got in zip(texts, periodic_runs._chunk(texts, 6, 4)):
            want = brute_runs(words)
            assert [tuple(r) for r in got.tolist()] == want
            if len(words) >= 6:  # the counted lags alone find the same
                for every in (1, 2, 5):
                    s, n, q = periodic_runs.runs_of(np.array([w[0] for w in words]), len(words), every=every)
                    assert list(zip(s.tolist(), n.tolist(), q.tolist())) == want


def test_long_periods():
    rng = random.Random(2)
    words = [b"%d" % rng.randrange(900) for _ in range(30000)]
    words[9000:9000] = (words[100:2300] * 5)[:9000]
    assert brute_runs(words[8990:18010]) == [(s - 8990, n, q) for s, n, q in map(tuple, periodic_runs._chunk([words], 6, 4)[0].tolist())]


def test_periodic_runs(spark, empty_docs, tmp_path):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += ["", None, " \n", "one", "no no no no no no", "no\tno\x0bno no no", "　 x " * 9, ("a b " * 30 + "c ") * 5, "w " * 4000]
    rows = [(i * 7 - 50, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a a a a a a a", 1, "x"), (6, texts[8], 1, "x"), (6, texts[8], 1, "x")]
    got = periodic_runs.digest(periodic_runs.find(periodic_runs.planted(saved(spark, tmp_path, rows, "doc_id long, text string, _w int, runs string")))).collect()

    def want(doc_id, text):
        words = (text or "").encode().split()
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        n = len(words)
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return (doc_id, len(runs), *head, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))

    assert sorted(map(repr, map(tuple, got))) == sorted(repr(want(d, t)) for d, t, *_ in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 5
    assert periodic_runs.digest(periodic_runs.find(periodic_runs.planted(empty_docs))).collect() == []


@pytest.fixture(scope="module")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b a b y")], "doc_id long, text string")
    row = periodic_runs.find(docs).first()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (12, [(1, 10, 2)], "x a b y")
    assert periodic_runs.find(docs.select(F.col("doc_id"), "text"), least=11).first()["runs"] == []
