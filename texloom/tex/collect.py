"""What the sources of a project declare: macros, registers, includes, title and abstract."""

from __future__ import annotations

import re
from collections import Counter

from texloom.tex import scan
from texloom.tex.segment import MARKER, Context, accented_text, segments

PROBE = "qwprobeword"
_ZERO = re.compile(r"\\(?:(?:new|renew|provide)command\*?\s*(?:\{\s*\\([A-Za-z@]+)\s*\}|\\([A-Za-z@]+))\s*|[gex]?def\s*\\([A-Za-z@]+)\s*)(?=\{)")
_MANY = re.compile(r"\\(?:(?:new|renew|provide)command\*?|DeclareRobustCommand\*?)\s*(?:\{\s*\\([A-Za-z@]+)\s*\}|\\([A-Za-z@]+))\s*\[(\d)\]\s*(\[[^\]]*\]\s*)?(?=\{)")
_DEF = re.compile(r"\\[gex]?def\s*\\([A-Za-z@]+)\s*((?:#\d)+)\s*(?=\{)")
_X = re.compile(r"\\(?:New|Renew|Provide|Declare)DocumentCommand\s*(?:\{\s*\\([A-Za-z@]+)\s*\}|\\([A-Za-z@]+))\s*\{((?:\s*m)+\s*)\}\s*(?=\{)")
_INCLUDE = re.compile(r"\\(input|include|subfile)(?![A-Za-z@])\s*(?:\{([^{}]*)\}|\"([^\"\n]+)\"|([^\s\\{}%]+))")


def _bodies(seen: str, pattern: re.Pattern):
    for m in pattern.finditer(seen):
        end = scan.closed(seen, m.end())
        if end:
            yield m, seen[m.end() + 1 : end - 1]


def zero_argument(text: str) -> dict[str, str]:
    """Macros without arguments and their bodies; the last definition holds."""
    return {m[1] or m[2] or m[3]: body for m, body in _bodies(scan.visible(text), _ZERO)}


_REGISTERS = frozenset("newdimen newlength newskip newmuskip newcount".split())


def declarations(text: str) -> str:
    """The whole definitions and register declarations of a text, over as many lines as they take, one after the other."""
    seen, out, past = scan.visible(text), [], 0
    for token in scan.COMMAND.finditer(seen):
        name = scan.command_name(token[0])
        if token.start() >= past and (name in scan.DEFINITIONS or name in _REGISTERS):
            past = scan.definition(seen, token.end(), name) if name in scan.DEFINITIONS else scan.arguments(seen, token.end(), 1)
            if name in _REGISTERS and past == token.end() and (register := scan.COMMAND.match(seen, scan.blank(seen, past))):
                past = register.end()
            out.append(seen[token.start() : past])
    return "\n".join(out)


def literal_macros(text: str) -> dict[str, str]:
    """TX8: macros that stand for plain text."""
    return {n: b for n, b in zero_argument(text).items() if b and not re.search(r"[\\{}$#%&~^_]", b)}


def math_aliases(text: str) -> dict[str, str]:
    """TX7: macros that open or close mathematics or an environment, through chains of aliases (GR5)."""
    bodies, out = {n: b.strip() for n, b in zero_argument(text).items()}, {}
    for name, body in bodies.items():
        for _ in range(16):
            chained = re.fullmatch(r"\\([A-Za-z@]+)", body)
            if not chained or chained[1] not in bodies:
                break
            body = bodies[chained[1]]
        body = re.sub(r"^\\(begin|end)\s+\{", r"\\\1{", body)
        if re.fullmatch(r"\\(?:begin|end)\{[^{}]+\}|\\[\[\]()]|\$\$?", body):
            out[name] = body
    return out | delimited_math(text)


_OWN_END = re.compile(r"\\def\s*\\([A-Za-z@]+|.)\s*#1\s*(\\(?:[A-Za-z@]+|.))\s*(?=\{)", re.S)
_WRAPPED = re.compile(r"(\$\$?|\\\(|\\\[|\\begin\{([^{}]+)\})\s*#1\s*(\$\$?|\\\)|\\\]|\\end\{([^{}]+)\})")


def delimited_math(text: str) -> dict[str, str]:
    r"""TX7: macros whose argument a token of their own ends and that only wrap it in mathematics, as \def\f#1\stop{$#1$}.

    The value is the opening, scan.DELIMITED and that token.
    """
    pairs, out = {"$": "$", "$$": "$$", r"\(": r"\)", r"\[": r"\]"}, {}
    for m, body in _bodies(scan.visible(text), _OWN_END):
        wrapped = _WRAPPED.fullmatch(body.strip())
        if wrapped and (wrapped[2] == wrapped[4] and wrapped[2] in scan.MATH_ENVIRONMENTS if wrapped[2] else wrapped[3] == pairs[wrapped[1]]):
            out[m[1]] = wrapped[1] + scan.DELIMITED + m[2]
    return out


def numeric_registers(text: str) -> dict[str, str]:
    """TX11: declared registers and what they hold."""
    kinds = {"newcount": "integer"}
    return {m[2]: kinds.get(m[1], "dimension") for m in re.finditer(r"\\(newdimen|newlength|newskip|newmuskip|newcount)\s*\{?\s*\\([A-Za-z@]+)", scan.visible(text))}


def macros_with_arguments(text: str) -> dict[str, tuple[int, str]]:
    """TX9, AG5: macros declared once, with mandatory arguments only: their number and body."""
    seen, found = scan.visible(text), []
    for m, body in _bodies(seen, _MANY):
        if not m[4]:
            found.append((m[1] or m[2], int(m[3]), body))
    found += [(m[1], m[2].count("#"), body) for m, body in _bodies(seen, _DEF)]
    found += [(m[1] or m[2], m[3].count("m"), body) for m, body in _bodies(seen, _X)]
    times = Counter(name for name, _, _ in found)
    return {name: (n, body) for name, n, body in found if times[name] == 1 and n}


def _shows(body: str, n: int, count: int, context: Context) -> bool:
    """Whether the n-th argument of a body is prose wherever it stands."""
    if f"#{n}" not in body:
        return False
    filled = body
    for k in range(1, count + 1):
        filled = filled.replace(f"#{k}", PROBE if k == n else "")
    plain = "".join(MARKER.sub("", s.masked) for s in segments(filled, context))
    return plain.count(PROBE) == filled.count(PROBE) > 0


def project_context(text: str) -> Context:
    """TX6, TX7, TX11, TX12: what a project's sources, taken together, say of their macros.

    A macro of one argument that shows it as prose is a text macro; of macros with more arguments the places
    of those that are prose are kept. Each argument is tried with a probe word, until nothing new is found.
    """
    declared, aliases, registers = macros_with_arguments(text), math_aliases(text), numeric_registers(text)
    texts, prose = frozenset(), {}
    for _ in range(16):
        context = Context(texts, aliases, registers, prose)
        more = {name for name, (n, body) in declared.items() if n == 1 and _shows(body, 1, 1, context)}
        places = {name: (n, tuple(k for k in range(1, n + 1) if _shows(body, k, n, context))) for name, (n, body) in declared.items() if n > 1}
        places = {name: v for name, v in places.items() if v[1]}
        if more == texts and places == prose:
            break
        texts, prose = frozenset(more), places
    return Context(texts, aliases, registers, prose)


def without_definitions(seen: str) -> str:
    """A visible text with macro definitions as blanks, every position kept."""
    out, done = [], 0
    for m in re.finditer(r"\\([A-Za-z]+)(?![A-Za-z@])", seen):
        if m.start() >= done and m[1] in scan.DEFINITIONS:
            end = scan.definition(seen, m.end(), m[1])
            out += [seen[done : m.start()], re.sub(r"[^\n]", " ", seen[m.start() : end])]
            done = end
    return "".join([*out, seen[done:]])


def include_edges(text: str, aliases: dict[str, str] | None = None) -> list[tuple[str, bool]]:
    """TX13: included names in order, with whether they stand in an opaque environment."""
    seen, opaque, past = without_definitions(scan.visible(text)), [], 0
    for m in scan.BEGIN.finditer(seen):
        if m.start() >= past and m[1] in scan.OPAQUE_ENVIRONMENTS:
            past = scan.environment_end(seen, m.end(), m[1], aliases or {})
            opaque.append((m.start(), past))
    out, at = [], 0
    for m in _INCLUDE.finditer(seen):
        name = (m[2] or m[3] or m[4] or "").strip()
        while at < len(opaque) and opaque[at][1] <= m.start():
            at += 1
        if name and "#" not in name and "\\" not in name:
            out.append((name, at < len(opaque) and opaque[at][0] <= m.start()))
    return out


def entry_parts(text: str) -> str:
    r"""TX14: the part of a file that takes effect: false branches are blank, nothing follows \endinput."""
    seen, out, hide, stack, done = scan.visible(text), [], 0, [], 0
    for m in re.finditer(r"\\(if[A-Za-z@]*|else|fi|endinput)(?![A-Za-z@])", seen):
        part = seen[done : m.start()]
        out.append(re.sub(r"[^\n]", " ", part) if hide else part)
        done, name = m.end(), m[1]
        known = name in ("iftrue", "iffalse") or (stack and stack[-1] is not None and name in ("else", "fi"))
        out.append(" " * len(m[0]) if known or hide else m[0])
        if name == "endinput" and not hide:
            return "".join(out[:-1])
        if name.startswith("if"):
            stack.append(name == "iftrue" if name in ("iftrue", "iffalse") else None)
        elif name == "else" and stack and stack[-1] is not None:
            stack[-1] = not stack[-1]
        elif name == "fi" and stack:
            stack.pop()
        hide = sum(s is False for s in stack)
    rest = seen[done:]
    return "".join([*out, re.sub(r"[^\n]", " ", rest) if hide else rest])


def expand_includes(files: dict[str, str], main: str, depth: int = 32, limit: int = 2_000_000) -> str:
    """GR3: the document of a project in reading order; cycles, deep and overlong inclusions are cut."""
    out, size = [], 0

    def resolve(name: str, here: str) -> str | None:
        for base in (main.rpartition("/")[0], here.rpartition("/")[0], ""):
            for candidate in (name, name + ".tex"):
                path = f"{base}/{candidate}" if base else candidate
                if path in files:
                    return path
        return None

    def walk(path: str, above: tuple[str, ...]) -> None:
        nonlocal size
        text, done = entry_parts(files[path]), 0
        for m in _INCLUDE.finditer(text):
            target = resolve((m[2] or m[3] or m[4] or "").strip(), path)
            out.append(text[done : m.start()])
            size += m.start() - done
            done = m.end()
            if target and target not in above and len(above) < depth and size < limit:
                walk(target, (*above, target))
        out.append(text[done:])
        size += len(text) - done

    if main in files:
        walk(main, (main,))
    return "".join(out)[:limit]


def abstract(text: str) -> str | None:
    """TX15: the abstract of an environment or a command, blanks collapsed; NULL without one."""
    seen = scan.visible(text)
    env = re.search(r"\\begin\s*\{abstract\*?\}(.*?)\\end\s*\{abstract\*?\}", seen, re.S)
    body = env[1] if env else None
    if body is None and (m := re.search(r"\\abstract(?![A-Za-z@])\s*(?=\{)", seen)):
        end = scan.closed(seen, m.end())
        body = seen[m.end() + 1 : end - 1] if end else None
    return re.sub(r"\s+", " ", body).strip() or None if body is not None else None


def title(text: str) -> str | None:
    """TX10, STR21: the first declared title for display: literal macros put in, accents composed, commands gone."""
    seen = scan.visible(text)
    for m in re.finditer(r"\\(?:icml)?title(?![A-Za-z@])\s*(?:\[[^\]]*\]\s*)?(?=\{)", seen):
        end = scan.closed(seen, m.end())
        if not end:
            continue
        body, literals = seen[m.end() + 1 : end - 1], literal_macros(text)
        for _ in range(16):
            put = re.sub(r"\\([A-Za-z@]+)\s*(?:\{\})?", lambda c: literals.get(c[1], c[0]), body)
            if put == body:
                break
            body = put
        body = re.sub(r"\\thanks\s*\{[^{}]*\}|\\\\", " ", body)
        body = accented_text(re.sub(r"\\(?:[a-zA-Z@]{2,}\*?)(?=\s*\{)", "", body))
        body = re.sub(r"\s+", " ", re.sub(r"\\[A-Za-z@]+\s?", "", body).replace("~", " ")).strip()
        if body:
            return body
    return None
