"""Edits of TeX sources: spans are found in the visible text and replaced in the original."""

from __future__ import annotations

import re

from texloom.tex import collect, scan


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """RW1: non-overlapping edits; of overlapping ones the outer, then the first, holds."""
    out, done = [], 0
    for start, end, value in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start >= done:
            out += [text[done:start], value]
            done = max(done, end)
    return "".join([*out, text[done:]])


def _found(text: str, pattern: str, value, flags: int = 0) -> list[tuple[int, int, str]]:
    return [(*m.span(1), value(m)) for m in re.finditer(pattern, scan.visible(text), flags)]


def float_positions(text: str) -> str:
    """RW2: positions that floats do not know are left out of their options; without any left, the default."""
    keep = lambda m: "".join(c for c in m[1] if c in "htbpH!") or "htbp"
    return apply_edits(text, _found(text, r"\\begin\s*\{(?:figure|table)\*?\}\s*\[([^\]\\]*)\]", keep))


def comment_terminators(text: str) -> str:
    """RW2: what follows the end of a comment environment on its line goes to a line of its own."""
    return re.sub(r"(?m)^([ \t]*\\end\{comment\})[ \t]*(?=\S)", "\\1\n", text)


def pixel_units(text: str) -> str:
    """RW2: lengths in px as big points of a 72 dpi screen."""
    return apply_edits(text, _found(text, r"(?<![A-Za-z0-9])(?:\d+(?:\.\d+)?|\.\d+)\s*(px)(?![A-Za-z])", lambda m: "bp"))


def wide_tables(text: str) -> tuple[str, int]:
    """RW4: each outermost tabular in a box that fits the line, and how many there were."""
    seen, edits, past = collect.without_definitions(scan.visible(text)), [], 0
    for m in scan.BEGIN.finditer(seen):
        if m.start() < past or m[1] not in ("tabular", "tabular*"):
            continue
        end = scan.math(seen, m.end(), r"\begin{" + m[1] + "}", {})
        past = end
        if not re.search(r"\\(?:resizebox|adjustbox|scalebox)[^\n]*$", seen[max(0, m.start() - 200) : m.start()]) and seen[:end].endswith(r"\end{" + m[1] + "}"):
            edits += [(m.start(), m.start(), "\\begin{adjustbox}{max width=\\linewidth}"), (end, end, "\\end{adjustbox}")]
    return apply_edits(text, edits), len(edits) // 2


def negative_spacers(text: str) -> tuple[str, int]:
    """RW5: vertical spaces of negative length in floats become zero, and how many there were."""
    seen, edits, past = scan.visible(text), [], 0
    for m in re.finditer(r"\\begin\s*\{((?:figure|table)\*?)\}", seen):
        if m.start() < past:
            continue
        past = scan.math(seen, m.end(), r"\begin{" + m[1] + "}", {})
        edits += [(m.end() + v.start(1), m.end() + v.end(1), "0pt") for v in re.finditer(r"\\vspace\*?\s*\{\s*(-[^{}]*)\}", seen[m.end() : past])]
    return apply_edits(text, edits), len(edits)


def long_identifiers(text: str, least: int = 24) -> str:
    """RW6: break points after underscores, dots and slashes of long words in typewriter type."""
    edits = []
    for m in re.finditer(r"\\texttt\s*\{([^{}$]*)\}", scan.visible(text)):
        for word in re.finditer(r"[^\s]+", m[1]):
            if len(word[0]) >= least:
                at = m.start(1) + word.start()
                edits += [(at + b.end(), at + b.end(), "\\allowbreak{}") for b in re.finditer(r"\\_|[./:-](?=[A-Za-z0-9])", word[0])]
    return apply_edits(text, edits)


def inject_preamble(text: str, lines: str) -> str:
    r"""RW7: lines before \begin{document}, or after the class; a text without either stays as it is."""
    seen = scan.visible(text)
    body = re.search(r"\\begin\s*\{document\}", seen)
    if body:
        return apply_edits(text, [(body.start(), body.start(), lines.rstrip("\n") + "\n")])
    head = re.search(r"\\document(?:class|style)", seen)
    if not head:
        return text
    at = scan.arguments(seen, head.end(), 1)
    return apply_edits(text, [(at, at, "\n" + lines.rstrip("\n"))])


def path_violations(text: str) -> list[str]:
    """FP7: file names that are absolute, leave the project or name a pipe, each once in order."""
    names = [n.strip() for n in re.findall(r"\\(?:input|include|subfile|includegraphics|bibliography|addbibresource|lstinputlisting)\*?\s*(?:\[[^\]]*\]\s*)?\{([^{}]*)\}", scan.visible(text))]
    bad = lambda n: n.startswith(("/", "|", "~", "\\")) or re.match(r"[A-Za-z]:", n) or escapes(n)
    return list(dict.fromkeys(n for n in names if bad(n)))


def escapes(name: str) -> bool:
    depth = 0
    for part in name.replace("\\", "/").split("/"):
        depth += -1 if part == ".." else part not in ("", ".")
        if depth < 0:
            return True
    return False


def rebase_path(name: str, exists) -> str:
    """RW8: leading ../ are left out if the rest names a file of the project."""
    short = re.sub(r"^(?:\.\./)+", "", name)
    return short if short != name and exists(short) else name


def graphic_references(text: str) -> list[tuple[int, int, str]]:
    """TX20: spans and names of included graphics."""
    return [(*m.span(1), m[1].strip()) for m in re.finditer(r"\\(?:includegraphics|epsfig|epsfbox)\*?\s*(?:\[[^\]]*\]\s*)*\{([^{}]*)\}", scan.visible(text))]


def redirect_graphics(text: str, renamed: dict[str, str]) -> str:
    """RW9: graphics under their new names."""
    return apply_edits(text, [(a, b, renamed[n]) for a, b, n in graphic_references(text) if n in renamed])


# RW12: log lines and what they point at; the first rule that fits counts.
DIAGNOSTICS = (
    ("missing_file", r"(?:LaTeX Error: )?File [`'].+?' not found"),
    ("undefined_command", r"Undefined control sequence"),
    ("missing_font", r"Font .+? not (?:found|loadable)|cannot be found.*font"),
    ("bad_graphic", r"Cannot determine size of graphic|Unable to load picture|pdf: .*(?:damaged|broken)"),
    ("option_clash", r"Option clash for package"),
    ("runaway", r"Runaway argument|File ended while scanning"),
    ("capacity", r"TeX capacity exceeded"),
)


def diagnose(log: str) -> str | None:
    """RW12: the class of a compiler's log."""
    return next((name for name, rule in DIAGNOSTICS if re.search(rule, log)), None)
