"""Golden cases and seeded properties of the TeX operators and sources."""

import gzip
import io
import json
import random
import tarfile
import zipfile

from pyspark.sql import functions as F

from texloom.functions import records, response
from texloom.sources import archives
from texloom.tex import collect, frames, project, requests, restore, rewrite, scan
from texloom.tex.segment import MARKER, Context, Segment, accented_text, movable, named_identifier, segments


def masked(text, context=None):
    return [s.masked for s in segments(text, context)]


def test_plain_text_is_one_segment():
    assert segments("") == segments(None) == []
    assert masked("Plain words, nothing else.") == ["Plain words, nothing else."]
    assert masked("one line\nsecond line\n\nnext words") == ["one line\nsecond line", "next words"]
    assert masked("12 + 3 é 7") == []


def test_values_and_names():
    s = segments(r"GPT-4 beats Top-5 by 50\% in \#3 of~12 cases")[0]
    assert s.protected == ["GPT-4", "5", r"50\%", r"\#3", "~12"]
    assert [named_identifier(w) for w in ("GPT-4", "Top-5", "x2", "Section-3", "A-7", "word")] == [True, False, True, False, True, False]
    assert segments("keep ```code 12``` here")[0].protected == ["```", "12", "```"]


def test_commands():
    assert segments(r"\section{A head} and \textbf{bold}")[0].protected == [r"\section", "{", "}", r"\textbf", "{", "}"]
    assert segments(r"see \cite[p.~3]{abc} there")[0].protected == [r"\cite[p.~3]{abc}"]
    assert segments(r"\kern0.04emTitle here")[0].protected == [r"\kern0.04em"]
    assert segments(r"x \verb|a % b| words")[0].protected == [r"\verb|a % b|"]
    assert segments("open $x + words to the end")[0].protected == ["$x + words to the end"]
    assert masked(r"\begin{align} foo bar \end{align}") == []
    assert masked("\\begin{verbatim}\nfoo bar\n\\end{verbatim} after words") == [" after words"]
    assert masked(r"\newcommand{\x}{some words} rest here")[0].endswith("rest here")
    pre = r"\documentclass{article} hidden words \title{Big Study} \author{N. N.\thanks{Paid by us}} \begin{document} Body text. \end{document} hidden"
    assert [(s.role, s.masked.strip()) for s in segments(pre)] == [("title", "Big Study"), ("paragraph", "Paid by us"), ("paragraph", "Body text.")]


def test_accents():
    assert segments(r"K\"oppen met Erd\H{o}s")[0].protected == [r"K\"oppen", r"Erd\H{o}s"]
    assert [accented_text(w) for w in (r"K\"oppen", r"Erd\H{o}s", r"\'{\i}", r"Stra\ss{}e")] == ["Köppen", "Erdős", "í", "Straße"]


def test_long_paragraphs_break_at_sentences():
    text = "Some words make one sentence. " * 400
    found = segments(text)
    assert "".join(s.source for s in found) == text
    assert all(len(s.source) < 4600 for s in found) and len(found) >= 2


def test_round_trip_of_random_texts():
    rng = random.Random(7)
    parts = ["word ", "two words. ", "\\textbf{", "}", "{", "$x$", "$", "% note\n", "\n\n", "\\\\", "&", "~", "12", "\\%", "\\cite{a}", "GPT-4 ", "\\begin{table}", "\\end{table}", "\\", "[", "]", "⟪P0000⟫", "```", "K\\\"o ", "\\verb|", "\\def\\a#1{", "中文字", "\\input ", "é"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 25)))
        end = 0
        for s in segments(text):
            assert s.source == text[s.start : s.end] == s.unmasked() and end <= s.start < s.end
            end = s.end
            assert restore.restore(s, s.masked) == (s.source, None), (text, s)
            assert "".join(restore.repair_chunks(s)) == s.masked
            for only in (False, True):
                small, expansion = restore.compact(s, only)
                assert small.unmasked() == s.source
                assert MARKER.sub(lambda m: expansion[m[0]], small.masked) == s.masked


def test_visible_keeps_positions():
    text = "a % c\n\\begin{verbatim}\n%x\n\\end{verbatim} b \\verb|%| c \\% d % e"
    seen = scan.visible(text)
    assert len(seen) == len(text) and [i for i, c in enumerate(seen) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert seen.split() == ["a", "b", "c", "\\%", "d"]
    assert scan.without_comments("a\\% b % c\nd") == "a\\% b    \nd"



def test_deep_and_open_groups():
    assert scan.group("{" * 100_000, 0) == 100_000
    assert scan.group("{" * 50_000 + "}" * 50_000 + "x", 0) == 100_000
    assert scan.closed("{a", 0) is None and scan.closed("{a}", 0) == 3
    assert segments("{" * 20_000 + " some words") != []


def test_restore_refuses():
    s = segments(r"We \textbf{use} $x$ of 12 and & cell words \\")[0]
    code = lambda change: restore.restore(s, change(s.masked))[1]
    assert code(lambda t: t) is None
    assert code(lambda t: t.replace("⟪P0003⟫", "")) == "markers_changed"
    assert code(lambda t: t.replace("⟪P0000⟫⟪P0001⟫", "⟪P0000⟫ x ⟪P0001⟫")) == "argument_separated"
    assert code(lambda t: t.replace("⟪P0001⟫", "⟪T⟫").replace("⟪P0002⟫", "⟪P0001⟫").replace("⟪T⟫", "⟪P0002⟫")) == "structure_reordered"
    assert code(lambda t: t.replace("⟪P0003⟫ ", "").replace("cell", "⟪P0003⟫ cell")) == "scope_crossed"
    assert code(lambda t: t.replace("of", r"\foo")) == "extra_command"
    assert code(lambda t: t.replace("⟪P0004⟫", "3⟪P0004⟫")) is None  # a number is no word
    assert restore.restore(s, None) == (None, "missing")
    assert restore.restore(segments("Many plain words are here")[0], "a") == (None, "too_short")
    assert restore.restore(segments("Plain words")[0], "50% & more_x") == (r"50\% \& more\_x", None)
    moved = s.masked.replace("⟪P0003⟫ of ⟪P0004⟫", "⟪P0004⟫ of ⟪P0003⟫")
    assert restore.restore(s, moved)[0] == s.source.replace("$x$ of 12", "12 of $x$")


def test_translate_keeps_the_source_after_failures():
    s = segments(r"A sentence. And \emph{another} one.")[0]
    assert restore.translate(s, lambda t, e: t.upper()) == (r"A SENTENCE. AND \emph{ANOTHER} ONE.", None, 1)
    text, error, calls = restore.translate(s, lambda t, e: "no")
    assert (text, error) == (s.source, "markers_changed") and calls == 4
    assert restore.recover_copied(s, r"Ein \emph{x}.") == "Ein ⟪P0000⟫{x}."


def test_macros():
    p = r"""\newcommand{\be}{\begin{equation}}\newcommand{\ee}{\end{equation}}\let\q\be \newcommand{\hi}[1]{\textbf{#1}}\newcommand{\two}[2]{\label{#1}\hi{#2}}
\newcommand{\key}[1]{\label{#1}}\newcommand{\sys}{Foo}\newlength{\w}\newcount\n"""
    c = collect.project_context(p)
    assert c == Context(frozenset({"hi"}), {"be": r"\begin{equation}", "ee": r"\end{equation}"}, {"w": "dimension", "n": "integer"}, {"two": (2, (2,))})
    assert [m.strip() for m in masked(r"A \hi{good} one \be x foo \ee and \two{lab}{inner prose} end.", c)] == ["A ⟪P0000⟫⟪P0001⟫good⟪P0002⟫ one ⟪P0003⟫ and", "inner prose", "end."]
    assert collect.literal_macros(p)["sys"] == "Foo"


def test_documents():
    assert collect.include_edges(r"\newcommand{\be}{\begin{equation}} \input{a} \begin{tikzpicture}\input{b}\end{tikzpicture} \include{c} % \input{d}") == [("a", False), ("b", True), ("c", False)]
    assert collect.entry_parts(r"\iffalse no \else yes \fi a \ifx q \else r \fi \endinput b").split() == ["yes", "a", r"\ifx", "q", r"\else", "r", r"\fi"]
    files = {"m.tex": r"a \input{s/b} c \input{none}", "s/b.tex": r"B \input{m} \input{d}", "s/d.tex": "D"}
    assert collect.expand_includes(files, "m.tex").split() == ["a", "B", "D", "c"]
    assert collect.expand_includes(files, "gone.tex") == ""
    assert collect.abstract(r"\begin{abstract} An  abstract. \end{abstract}") == "An abstract." and collect.abstract("x") is None
    assert collect.title(r"\newcommand{\sys}{Foo}\title{The \emph{\sys} of K\"oppen\thanks{x} % c" + "\n}") == "The Foo of Köppen"


def test_rewrites():
    assert rewrite.apply_edits("abcdef", [(1, 3, "X"), (2, 3, "no"), (4, 4, "Y")]) == "aXdYef"
    assert rewrite.float_positions(r"\begin{figure}[Zht] \begin{table}[Q] % \begin{table}[Q]") == r"\begin{figure}[ht] \begin{table}[htbp] % \begin{table}[Q]"
    assert rewrite.pixel_units("width=12px apx 3 px") == "width=12bp apx 3 bp"
    assert rewrite.comment_terminators("\\end{comment} rest") == "\\end{comment}\nrest"
    text, n = rewrite.wide_tables(r"a \begin{tabular}{c} \begin{tabular}{c} x \end{tabular} \end{tabular} b")
    assert n == 1 and text.count("adjustbox") == 2 and text.endswith(r"\end{tabular}\end{adjustbox} b")
    assert rewrite.negative_spacers(r"\vspace{-1em}\begin{figure} \vspace{-2em} \vspace{1em} \end{figure}") == (r"\vspace{-1em}\begin{figure} \vspace{0pt} \vspace{1em} \end{figure}", 1)
    assert rewrite.long_identifiers(r"\texttt{a.b} \texttt{org.example.deep.Name\_of\_thing}") == r"\texttt{a.b} \texttt{org.\allowbreak{}example.\allowbreak{}deep.\allowbreak{}Name\_\allowbreak{}of\_\allowbreak{}thing}"
    assert rewrite.inject_preamble("\\documentclass{a}\n\\begin{document}", "\\x") == "\\documentclass{a}\n\\x\n\\begin{document}"
    assert rewrite.path_violations(r"\input{/etc/x} \input{a/../../b} \input{a/../b} \input{|ls} \includegraphics[w]{c:/x}") == ["/etc/x", "a/../../b", "|ls", "c:/x"]
    assert rewrite.redirect_graphics(r"\includegraphics[w=1]{a.eps} \includegraphics{b}", {"a.eps": "a.pdf"}) == r"\includegraphics[w=1]{a.pdf} \includegraphics{b}"
    assert rewrite.diagnose("! Undefined control sequence.") == "undefined_command" and rewrite.diagnose("fine") is None


def _tar(link=False, name="a/m.tex"):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        e = tarfile.TarInfo(name)
        if link:
            e.type, e.linkname = tarfile.SYMTYPE, "/etc/passwd"
        else:
            e.size = 2
        t.addfile(e, io.BytesIO(b"hi"))
    return b.getvalue()


def test_archives(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("p/main.tex", "\\documentclass{a}")
        f.writestr("__MACOSX/x", "no")
        f.writestr(".git/x", "no")
    blobs = {"a.zip": z.getvalue(), "b.tgz": _tar(), "c.tgz": _tar(True), "d.tgz": _tar(False, "../up"), "e.gz": gzip.compress("中".encode("gb18030")), "f.bin": b"%PDF-1.4", "g.zip": b"PK\x03\x04junk"}
    for name, blob in blobs.items():
        (tmp_path / name).write_bytes(blob)
    got = {(r.project[-5:].lstrip("/"), r.path, r.text, r.error) for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert got == {("a.zip", "p/main.tex", "\\documentclass{a}", None), ("b.tgz", "a/m.tex", "hi", None), ("c.tgz", None, None, "link"), ("d.tgz", None, None, "unsafe_path"), ("e.gz", "main.tex", "中", None), ("f.bin", None, None, "pdf"), ("g.zip", None, None, "damaged")}
    assert archives.rule_inputs("out: a.tex b\\ c.tex \\\n d$$.tex") == ["a.tex", "b c.tex", "d$.tex"]
    assert archives.control_inputs('<r xmlns="u"><datasource> a.bib </datasource></r>') == ["a.bib"] and archives.control_inputs("<!DOCTYPE x><r/>") is None


def test_responses():
    assert response.strip_reasoning("<think>a<think>b</think></think> ok") == ("ok", None)
    assert response.strip_reasoning("<think>a") == response.strip_reasoning("a</think>") == (None, "ambiguous")
    m = "a < ⟪P0001⟫ & ⟪P0000⟫b"
    xml, shown = requests.encode_xml(Segment(0, 0, "", m, ["$a<b$", r"\textbf{"]))
    assert shown == {"P0000": "$a<b$", "P0001": "P0001"} and requests.decode_xml(xml, shown) == (m, None)
    bad = ('<p><ph id="P0000">x</ph><ph id="P0001">P0001</ph></p>', "<p><b/></p>", "<p>", "<s/>", "<p><?x?></p>", '<p><ph id="P0000">$a&lt;b$</ph></p>', xml.replace("<p>", "<p>" + '<ph id="P0001">P0001</ph>'))
    assert [requests.decode_xml(x, shown)[1] for x in bad] == ["markers_changed", "markers_changed", "invalid_xml", "invalid_xml", "invalid_xml", "markers_changed", "markers_changed"]
    assert requests.encode_xml(Segment(0, 0, "", "a\x01", []))[0] is None
    asked = json.loads(requests.payload(Segment(0, 0, "", m, ["$a<b$", r"\textbf{"]), feedback="again"))
    assert asked == {"paragraph": m, "value_tokens": {"⟪P0000⟫": "$a<b$"}, "fixed_format_order": ["⟪P0001⟫"], "fixed_text_context": {"⟪P0001⟫": r"\textbf{"}, "previous_validation_error": "again"}
    assert json.loads(requests.xml_body(["<p>x</p>"], "en", glossary="g")[0])["glossary_id"] == "g" and requests.xml_body(["x" * 140_000], "en") == (None, "too_large")
    page = '<meta name="citation_title" content="A  title"><meta name="citation_arxiv_id" content="2401.00001"><div class="submission-history"><b>[v1]</b> <div>[v3]</div></div>[v9]'
    assert response.page_title(page, "2401.00001v2") == "A title" and response.page_title(page, "2401.00002") is None
    assert response.history_versions(page) == [1, 3]
    assert [response.slot_error(v, "s") for v in (None, 5, " ", "⟪", "\\a", "ok")] == ["missing", "not_a_string", "empty_text", "protected_token", "invalid_syntax", None]


def test_records(spark):
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert [one(records.strict_base64(F.lit(v))) for v in ("aGk=", "aGk", "a Gk=", "")] == [b"hi", None, None, b""]
    assert [one(records.headers_error(F.expr(f"map({m})"))) for m in ("'X-A', 'b'", "'Host', 'b'", "'a b', 'c'", "'A', 'b', 'a', 'c'", "'A', 'b\nc'")] == [None, "reserved_name", "invalid_name", "repeated_name", "invalid_value"]
    fields = F.array(F.lit("see 2401.00001"), F.lit("Version: 2"), F.lit(None))
    assert one(records.record_ids(fields, F.lit("Version: 2\nversion: v3"))) == ["2401.00001", "2401.00001v2", "2401.00001v3"]
    assert one(records.record_ids(F.array(F.lit("2401.00001 cs.CL/0101001v1")), F.lit("version: 2"))) == ["2401.00001", "cs.CL/0101001v1"]
    assert one(records.message(F.lit("{a} of {b}"), F.expr("map('a', '1')"))) == "1 of {b}"
    assert one(records.message(F.lit("{a} of 3 pages"), F.expr("map('a', '{count}', 'count', '1')"))) == "{count} of 3 page"
    stamp = lambda t: tuple(one(records.page_stamp(F.lit(t), F.lit("2401.00001"))))
    assert one(records.stamp_version(F.lit("arXiv:2401.00001v2 [cs.CL] 1 Jan"), F.lit("2401.00001"))) == "2401.00001v2"
    assert stamp("arXiv:2401.00001v2 and arXiv:2402.00009v1") == ("2401.00001v2", None)
    assert stamp("arXiv:2401.00001v2 and arXiv:2402.00009v1 [cs.CL]") == (None, "id_conflict")
    assert stamp("arXiv:2401.00001v2 arXiv:2401.00001v3") == (None, "version_ambiguous")
    assert [one(records.page_number(F.lit(v), F.lit(4), F.lit(9))) for v in (" 7.9 ", "x", "", "-2", "1e5")] == [7, 4, 4, 1, 9]
    assert [one(records.zoom(F.lit(1.0), F.lit(w))) for w in (0.0, -5000.0, 5000.0)] == [1.0, 2.5, 0.5]
    assert one(records.header_names(F.expr("map('X-B', ' v ', 'X-A', 'w')"))) == ["x-a", "x-b"] and one(records.header_names(F.expr("map('Te', 'v')"))) == []
    assert one(records.headers_error(F.expr("map_from_entries(transform(sequence(1, 17), i -> struct(concat('h', i), 'v')))"))) == "too_many"
    assert one(records.headers_error(F.expr("map_from_entries(transform(sequence(1, 5), i -> struct(concat('h', i), repeat('v', 4000))))"))) == "too_large"
    assert one(records.matrix_product(F.expr("array(1d,0d,0d,1d,2d,3d)"), F.expr("array(2d,0d,0d,2d,1d,1d)"))) == [2, 0, 0, 2, 5, 7]


def test_frames(spark):
    files = spark.createDataFrame([("p", "m.tex", r"\title{Big} \newcommand{\hi}[1]{\textbf{#1}} \begin{abstract} Ab. \end{abstract} \input{s}"), ("p", "s.tex", r"Some \hi{text here}."), ("q", "e.tex", None)], "project string, path string, text string")
    found = frames.segment_table(files.join(frames.contexts(files), "project"), "path", "text", "context")
    assert [r.masked for r in found.where("path = 's.tex'").collect()] == ["Some ⟪P0000⟫⟪P0001⟫text here⟪P0002⟫."]
    assert [(r.path, r.name) for r in frames.includes(files, "project", "path").collect()] == [("m.tex", "s")]
    main = spark.createDataFrame([("p", "m.tex")], "project string, main string")
    r = frames.documents(files, main).collect()[0]
    assert (r.title, r.abstract) == ("Big", "Ab.") and r.document.endswith("Some \\hi{text here}.")
    done = frames.translated(frames.segment_table(files, "path"), lambda t, e: t.replace("text", "TEXT")).where("path = 's.tex'").collect()[0].translation
    assert done.value is not None and done.error is None
    assert frames.segment_table(files.limit(0), "path").count() == 0


def test_inventory_against_plain_python(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {(r.lang, r.src): r.segments for r in entry.queries()["segment_inventory"](spark, sf).collect()}
    want = {}
    for d in docs:
        n = len(segments(d.text))
        if n:
            want[d.lang, d.source] = want.get((d.lang, d.source), 0) + n
    assert got == want
    plain = [d for d in docs if d.text and not set(d.text) & set("\\%${}[]&#_^~⟪`") and "\n\n" not in d.text and len(d.text) <= 4500]
    assert len(plain) > 100 and all(len(segments(d.text)) == 1 for d in plain)


def test_segment_markers_of_a_segment_alone():
    assert Segment(0, 0, "a", "⟪P0000⟫", ["a"]).unmasked() == "a"


def test_movable_tokens():
    yes = [r"\ie", r"\etal", "~", r"\&", r"\%", r"\_", r"\{", "5.3\\%", "\\#2", r"~\cite{yolo}", r"\citeauthor{x}", r"\cref{a}", "$x$", r"\(x\)", "12,288", "175 billion", "GPT-3", "F-16", "YOLOv8"]
    no = ["&", "{", "}", "$$x$$", r"\verb|foo|", r"\texttt{a}", r"\url{a}", r"\nameref{a}", r"\vref{a}", "Top-5", "Section-3", r"\textbf", r"\\", r"\[", "a-5"]
    assert all(map(movable, yes)) and not any(map(movable, no))


def test_restore_by_the_contract():
    s = segments(r"With 5.3\% less latency, see \#2 and baseline~\cite{yolo}.")[0]
    assert s.protected == [r"5.3\%", r"\#2", r"~\cite{yolo}"]
    assert restore.restore(s, "see ⟪P0001⟫ and ⟪P0002⟫, the latency is less by ⟪P0000⟫.") == (r"see \#2 and ~\cite{yolo}, the latency is less by 5.3\%.", None)
    s = segments(r"Call \verb|foo| before \verb|bar| here.")[0]
    assert restore.restore(s, s.masked) == (s.source, None)
    swapped = s.masked.replace("⟪P0000⟫", "⟪X⟫").replace("⟪P0001⟫", "⟪P0000⟫").replace("⟪X⟫", "⟪P0001⟫")
    assert restore.restore(s, swapped) == (None, "structure_reordered")
    s = segments(r"It improves by \textbf{5\%} with 2 layers.")[0]
    assert restore.restore(s, "Up by ⟪P0002⟫, with ⟪P0000⟫⟪P0001⟫⟪P0004⟫⟪P0003⟫ layers.") == (None, "scope_crossed")
    s = segments(r"We use 2 layers. \small With 5 filters.")[0]
    assert restore.restore(s, "Uses ⟪P0002⟫ layers. ⟪P0001⟫ With ⟪P0000⟫ filters.")[1] == "scope_crossed"
    s = segments("GPT-3 has 175 billion parameters, or 175B; we test 12,288 and 3.6 million.")[0]
    assert s.protected == ["GPT-3", "175 billion", "175B", "12,288", "3.6 million"] and restore.restore(s, s.masked)[0] == s.source
    s = segments(r"Our model uses \emph{fewer} filters than VGG \cite{vgg}.")[0]
    assert restore.restore(s, "相比VGG⟪P0003⟫，模型使用⟪P0000⟫⟪P0001⟫更少⟪P0002⟫的滤波器。") == (r"相比VGG\cite{vgg}，模型使用\emph{更少}的滤波器。", None)


def test_joined_parts():
    assert restore._joined([r"\model", "", "Name"]) == r"\model Name"
    assert restore._joined([r"\item", "我们提出一种方法。"]) == r"\item 我们提出一种方法。"
    assert restore._joined([r"\\", "Name"]) == r"\\Name" and restore._joined([r"\\foo", "Name"]) == r"\\fooName"
    assert restore._joined([r"\textbf{", "Name", "}"]) == r"\textbf{Name}"


def test_all_lengths_and_mathematics():
    assert masked(r"Words \abovedisplayskip=3pt plus 1pt go on.") == ["Words ⟪P0000⟫ go on."]
    for env in ("dgroup", "dgroup*", "mathpar", "IEEEeqnarraybox"):
        assert masked(rf"Some words \begin{{{env}}} alpha beta \end{{{env}}} go on.") == ["Some words ⟪P0000⟫ go on."]
    assert scan.math(r"a \text{in $b$ it} c$ d", 0, "$", {}) == len(r"a \text{in $b$ it} c$")
    assert scan.math("a % $\n b$$ c", 0, "$", {}) == len("a % $\n b$")
    assert scan.math(r"x \begin{align} y \end{align} \end {align} z", 0, r"\begin{align}", {}) == len(r"x \begin{align} y \end{align} \end {align}")
    assert scan.arguments("[a] {b}% c\n{d}", 0) == len("[a] {b}% c\n{d}") and scan.arguments("{a}\n\n{b}", 0) == 3
    assert scan.arguments("[a]{b}[c]{d}", 0, 1) == 6 and scan.arguments("[a]{b}", 0, 0) == 3 and scan.arguments("x{b}", 0, 1) == 0


def test_delimited_mathematics():
    p = r"\def\formula#1\stop{$#1$} \def\eqn#1\done{ \begin{align}#1\end{align} } \def\no#1\stop{$#1+1$} \def\bad#1\stop{\begin{align}#1\end{gather}}"
    c = collect.project_context(p)
    assert set(c.math_aliases) == {"formula", "eqn"}
    assert masked(r"We take \formula a in words \stop and then \eqn more words \done to the end.", c) == ["We take ⟪P0000⟫ and then ⟪P0001⟫ to the end."]


def test_prose_at_any_depth():
    macro = Context(prose_arguments={"a": (1, (1,))})
    text = "".join(rf"\a{{level {n} words " for n in range(60)) + "}" * 60
    assert len(segments(text, macro)) == 60 and "level 59" in segments(text, macro)[-1].source


def test_projects():
    files = {"m.tex": r"\input{pre/a} \begin{document} \input{x} \end{document}", "pre/a.tex": r"\input{b} % \documentclass{no}", "pre/b.tex": r"\documentclass{article}", "x.tex": r"\documentclass{x}\begin{document}"}
    assert project.class_file(files, "m.tex") == "pre/b.tex" and project.class_file(files, "gone.tex") is None
    assert project.class_file({"m.tex": r"\input{x}", "x.tex": files["x.tex"]}, "m.tex") is None
    assert project.class_file({"m.tex": r"\input{m}\input{/etc/a}\input{../a}", "a.tex": r"\documentclass{a}"}, "m.tex") is None
    deep = {f"f{i}.tex": rf"\input{{f{i + 1}}}" for i in range(70)} | {"f70.tex": r"\documentclass{a}"}
    assert project.class_file(deep, "f0.tex") is None and project.class_file(deep, "f10.tex") == "f70.tex"
    macros = {r"\dir": r"\root/fig", r"\root": "out", r"\a": r"\b", r"\b": r"\a", r"\q": "{x}"}
    assert [project.expand_path(v, macros) for v in (r"\dir/one.eps", r"\root{} two.eps", "plain ", r"\a", r"\gone/x", r"\q", r"a\%b")] == ["out/fig/one.eps", "outtwo.eps", "plain", None, None, None, None]
    bodies = {r"\p": (r"\x.eps", "b.pdf"), r"\x": ("one",)}
    assert project.ambiguous_path(r"\p", bodies, {}, {r"\p"}) and not project.ambiguous_path(r"\x", bodies, {}, {r"\p"})
    assert project.ambiguous_path(r"\al", bodies, {r"\al": (r"\p",)}, {r"\x"}) and not project.ambiguous_path("a.eps", bodies, {}, {r"\p"})
    stored = {"m.tex": rb"\title{On \sys{} things}", "d.tex": rb"\newcommand{\sys}{Foo}\title{Other}", "bad.tex": b"\xff"}
    assert project.stored_title(stored, "m.tex", ["d.tex"]) == "On Foo things"
    assert project.stored_title(stored, "m.tex", ["bad.tex"]) is None and project.stored_title(stored, "m.tex", ["none.tex"]) is None
    assert project.stored_title(stored, "m.tex", ["d.tex"], budget=10) is None and project.stored_title(stored, "m.tex", ["d.tex"], most=1) is None
    text = r"\x {\y} \begin{document}\z \begin{center}\u\end{center} \begingroup \v \endgroup \w"
    assert project.scoped_positions(text, [text.index(c) for c in (r"\x", r"\y", r"\z", r"\u", r"\v", r"\w")]) == {text.index(c) for c in (r"\y", r"\u", r"\v")}


def test_slots_and_probe():
    s = segments(r"We \textbf{use} $x$ of 12 kinds, and more.")[0]
    assert [s.masked[a:b] for a, b in restore.slots(s.masked)] == ["We", "use", "of", "kinds, and more."]
    asked = []

    def client(texts):
        asked.append(dict(texts))
        return {n: None if t == "of" and len(texts) > 1 else t.upper() for n, t in texts.items()}

    assert restore.translate_slots(s, client, 3) == (r"WE \textbf{USE} $x$ OF 12 KINDS, AND MORE.", None, 3) and [len(a) for a in asked] == [3, 1, 1]
    text, error, calls = restore.translate_slots(s, lambda texts: [], 8)
    assert (text, error, calls) == (s.source, "missing", 5)
    assert restore.translate_slots(s, lambda texts: {n: "\\foo" for n in texts})[0] == s.source
    assert restore.target_probe(s, None) == s.source and restore.target_probe(s, "译文") == r"译文 \textbf{译文} $x$ 译文 12 译文, 译文 译文."
