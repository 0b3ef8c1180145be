"""The token table against the scanners of plain Python, and cases of declarations, accents and joins."""

import random
import re

from pyspark.sql import functions as F

from texloom.tex import collect, frames, restore, scan, tokens
from texloom.tex.segment import Segment, literal_value, segments

PARTS = ["$", "$$", "{", "}", "\\(", "\\)", "\\[", "\\]", "a b", "x", "% c $ {", "\n", "\\begin{equation}", "\\end{equation}", "\\begin {align*}", "\\end{align*}", "\\verb|$ %|", "\\verb*", "\\lstinline[a=b]{$}",
         "\\begin{verbatim}", "\\end{verbatim}", "\\$", "\\%", "\\{", "\\begingroup", "\\endgroup", "\\alpha", "[", "]", "\\newtcblisting{foo}{x}", "\\begin{foo}", "\\end{foo}", "é😀", "\\verb", "\\", "", None]


def made(n=1200):
    rng = random.Random(3)
    texts = ["".join(p for p in rng.choices(PARTS, k=rng.randrange(40)) if p) for _ in range(n)]
    return [*texts, "", "{" * 3000 + "}" * 3000, "$a$ " * 2000, None]


def formulas(seen):
    """Outermost mathematics, by the plain scanner."""
    out, past = [], 0
    for m in re.finditer(scan.COMMAND.pattern + r"|\$\$?", seen, re.S):
        env = scan.BEGIN.match(seen, m.start())
        if m.start() >= past and (m[0] in ("$", "$$", r"\[", r"\(") or (env and env[1] in scan.MATH_ENVIRONMENTS)):
            past = scan.math(seen, env.end() if env else m.end(), rf"\begin{{{env[1]}}}" if env else m[0], {})
            out.append((m.start(), past))
    return out


def test_tokens_read_as_the_scanners_do(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 8)
    texts = made()
    t = F.col("t")
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("e", tokens.declared_environments(t)).withColumn("seen", tokens.visible(t, F.col("e")))
    for r in d.withColumn("m", tokens.math_ranges(F.col("seen"))).withColumn("all", F.array_join(tokens.read(t, F.col("e")), "")).withColumn("nc", tokens.without_comments(t)).collect():
        text = texts[r["i"]]
        if text is None:
            assert r["seen"] is None and r["m"] is None and r["e"] is None
            continue
        assert r["all"] == text and r["nc"] == scan.without_comments(text)
        assert set(r["e"]) == scan.literal_environments(text) - scan.CODE_ENVIRONMENTS
        assert r["seen"] == scan.visible(text)
        assert [tuple(x) for x in r["m"]] == formulas(r["seen"])


def test_groups(spark):
    texts = made(500)
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    table = tokens.table(d, "i", "t")
    found = {}
    for r in tokens.groups(table, "i").collect():
        found.setdefault(r["i"], []).append(r)
    shown = tokens.spans(table, "i").groupBy("i").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()
    blanks = {i: sum(a != b for a, b in zip(t, scan._masked(t, scan.CODE_ENVIRONMENTS))) for i, t in enumerate(texts) if t}
    assert all(r["n"] >= blanks[r["i"]] > 0 for r in shown) and {r["i"] for r in shown} == {i for i, n in blanks.items() if n}
    for i, text in enumerate(texts):
        seen = scan._masked(text or "", scan.CODE_ENVIRONMENTS)
        opens = [m.start() for m in re.finditer(r"\\(?:[a-zA-Z@]+|.)|[{\[]", seen, re.S) if m[0] in "{["]
        got = sorted(found.get(i, []), key=lambda r: r["start"])
        assert [r["start"] for r in got] == opens
        for r in got:
            if r["kind"] == "{" or r["closed"]:
                assert r["end"] == scan.group(seen, r["start"])
            around = [g for g in got if g["kind"] == "{" and g["start"] < r["start"] and (r["start"] < g["end"] or not g["closed"])]
            assert r["depth"] == len(around) and r["parent"] == max((g["start"] for g in around), default=None)


def test_groups_without_a_row_for_each_token(spark, monkeypatch):
    deep = "{a " * 3000 + "[" + "}" * 2999
    texts = made(500) + ["", "no", "}{", "[{]}]", "{[}]", "[[]", "{" * 5, deep, "}" * 9 + "[a]{b}"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    want = sorted(map(str, tokens.groups(tokens.table(d, "i", "t"), "i").collect()))
    for most in (tokens.BRACKETS_AT_ONCE, 50):
        monkeypatch.setattr(tokens, "BRACKETS_AT_ONCE", most)
        found = tokens.text_groups(d, "i", "t")
        assert sorted(map(str, found.collect())) == want and len(want) > 3000
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan
    assert tokens.text_groups(d.limit(0), "i", "t").collect() == []


def test_declarations_that_are_only_printed():
    printed = "\\begin{verbatim}\n\\lstnewenvironment{itemize}{}{}\n\\end{verbatim}\n\\begin{itemize}\\item Some words here\\end{itemize}"
    assert scan.literal_environments(printed) == scan.CODE_ENVIRONMENTS
    assert any("Some words here" in s.masked for s in segments(printed))
    for name, n in scan.LITERAL_CONSTRUCTORS.items():
        text = f"\\{name}[o]{{Pro}}[x]" + "{a}" * n + "\n\\begin{Pro} % $x$ words\n\\end{Pro} y"
        assert scan.visible(text).split() == [text.split("\n")[0], "y"], name
        assert scan.literal_environments(f"\\{name}{{Pro}}" + "{a}" * (n - 1)) == scan.CODE_ENVIRONMENTS
    # a declaration behind the listing that prints another one
    late = "\\begin{Pro}\n\\newtcblisting{quote}{}\n\\end{Pro}\\newtcblisting{Pro}{}\n\\begin{quote}a % b\n\\end{quote}"
    assert "Pro" in scan.literal_environments(late) and "quote" not in scan.literal_environments(late)
    assert scan.literal_environments("\\newcommand{\\x}{\\newtcblisting{foo}{}}") == scan.CODE_ENVIRONMENTS


def test_numbers_and_lengths():
    take = lambda f, t: t[: f(t, 0)]
    assert take(scan.integer, "=%c\n -'17x") == "=%c\n -'17" and take(scan.integer, "`\\%x") == "`\\%" and take(scan.integer, "x") == ""
    assert take(scan.integer, "\\numexpr 1+\\numexpr2\\relax %\\relax\n+3\\relax x") == "\\numexpr 1+\\numexpr2\\relax %\\relax\n+3\\relax"
    assert take(scan.dimension, "0.04emTitle") == "0.04em" and take(scan.dimension, " = 1 pt plus 1fil minus.5ex and") == " = 1 pt plus 1fil minus.5ex"
    assert take(scan.dimension, "\\dimexpr 1pt+2pt\\relax x") == "\\dimexpr 1pt+2pt\\relax" and take(scan.dimension, "-\\foo2x") == "-\\foo2" and take(scan.dimension, "12 words") == ""
    assert take(lambda t, a: scan.partial_rule(t, a), "[2pt](l{)}r){2-3}x") == "[2pt](l{)}r){2-3}"
    assert take(lambda t, a: scan.inline_code(t, a, "lstinline"), "[x]{a{b}}c") == "[x]{a{b}}" and take(lambda t, a: scan.inline_code(t, a, "verb"), "|a b|c") == "|a b|"
    assert take(lambda t, a: scan.definition(t, a, "newcommand"), "{\\note}[1]{%\nbody {x}\n} y") == "{\\note}[1]{%\nbody {x}\n}" and take(lambda t, a: scan.definition(t, a, "def"), "\\a#1\\b{c}d") == "\\a#1\\b{c}"


def test_contexts_keep_whole_definitions(spark):
    text = "\\newcommand{\\note}[1]{%\n  \\textit{#1}\n}\n\\newcommand{\\other}[1]{\\textbf{#1}}\n\\newlength\\gap\n\\newcount{\\num}\nWords."
    assert collect.declarations(text).count("\n") == 5
    row = frames.contexts(spark.createDataFrame([("p", "a.tex", text), ("p", "b.tex", None)], "project string, path string, text string")).first()
    assert set(row["context"]["text_macros"]) == {"note", "other"} and dict(row["context"]["registers"]).keys() == {"gap", "num"}


def test_movable_words_and_joins():
    s = segments("We thank Erd\\H{o}s and G\\\"odel for GPT-4 and more")[0]
    swapped = s.masked.replace("⟪P0000⟫", "⟪T⟫").replace("⟪P0001⟫", "⟪P0000⟫").replace("⟪T⟫", "⟪P0001⟫")
    assert restore.restore(s, swapped)[1] is None
    assert literal_value("Erd\\H{o}s") and literal_value("\\foo") is None and literal_value("~\\foo{}", {"foo": "Foo"}) == "Foo"
    own = Segment(0, 0, "", "the ⟪P0000⟫ and ⟪P0001⟫ words", ["\\sys", "\\alg"])
    assert restore.restore(own, "the ⟪P0001⟫ and ⟪P0000⟫ words")[1] == "structure_reordered"
    own.literal_macros = {"sys": "Foo", "alg": "Bar"}
    assert restore.restore(own, "the ⟪P0001⟫ and ⟪P0000⟫ words")[1] is None
    named = next(f"⟪P{n:04d}⟫" for n, v in enumerate(s.protected) if v == "GPT-4")
    assert restore.restore(s, s.masked.replace(named, "v.1-" + named))[1] == "protected_word_joined"
    assert restore.restore(s, s.masked.replace(named, named + "-based"))[1] is None
    assert restore.word_joins(s, "a" + named + ".x-") == {named: ("a", ".x-")}


def test_restored_takes_macros(spark):
    d = spark.createDataFrame([("⟪P0000⟫ and ⟪P0001⟫ words", ["\\sys", "\\alg"], "⟪P0001⟫ and ⟪P0000⟫ words", {"sys": "Foo", "alg": "Bar"})], "m string, p array<string>, o string, k map<string,string>")
    assert d.select(frames.restored("m", "p", "o", F.col("k")).alias("r")).first()["r"]["error"] is None
    assert d.select(frames.restored("m", "p", "o").alias("r")).first()["r"]["error"] == "structure_reordered"


def test_path_violations(spark):
    texts = [r"\input{/etc/x} \input{a/../../b} \input{a/../b} \input{|ls} \includegraphics[w]{c:/x}", "\\openin\\x ~/y \\openout ../z %\n \\input ../z\\include{ok}", r"\inputs{/x} \input{../../q} \input{~u} \input{../../q}", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: (r["a"], r["b"]) for r in d.select("i", tokens.path_violations(F.col("t")).alias("a"), tokens.path_violations(F.col("t"), F.lit("./s/main.tex")).alias("b")).collect()}
    assert got[0] == (["/etc/x", "a/../../b", "|ls", "c:/x"], ["/etc/x", "|ls", "c:/x"])
    assert got[1] == (["../z", "../z\\include"], []) and got[2] == (["../../q", "~u"], ["../../q", "~u"])
    assert got[3] == (None, None) and got[4] == ([], [])
