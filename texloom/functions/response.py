"""Answers of services and pages: reasoning envelopes, slots, page heads. Plain functions of a text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_TAG = re.compile(r"<(/?)(think|thinking|reasoning|analysis)\b[^>]*>", re.I)


def strip_reasoning(text: str, depth: int = 8) -> tuple[str | None, str | None]:
    """STR14: (answer, None) without its leading reasoning; tags that do not balance give (None, "ambiguous")."""
    out, open_tags, done = [], [], 0
    for m in _TAG.finditer(text):
        if not m[1]:
            if not open_tags:
                out.append(text[done : m.start()])
            open_tags.append(m[2].lower())
            if len(open_tags) > depth:
                return None, "ambiguous"
        elif open_tags and open_tags.pop() == m[2].lower():
            done = m.end()
        else:
            return None, "ambiguous"
    if open_tags:
        return None, "ambiguous"
    return "".join([*out, text[done:]]).strip(), None


def slot_error(value, source: str) -> str | None:
    """VL5: why the answer for a slot is refused."""
    if value is None:
        return "missing"
    if not isinstance(value, str):
        return "not_a_string"
    if not value.strip() and source.strip():
        return "empty_text"
    if "⟪" in value or "⟫" in value:
        return "protected_token"
    if "\\" in value or "```" in value or re.search(r"\$[^$]+\$", value):
        return "invalid_syntax"
    return None


class _Head(HTMLParser):
    def __init__(self):
        super().__init__()
        self.meta, self.versions = [], []
        self._in_history, self._depth = False, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            self.meta.append(((a.get("name") or "").lower(), a.get("content") or ""))
        if tag == "div":
            self._depth += self._in_history
            if "submission-history" in (a.get("class") or "").split():
                self._in_history, self._depth = True, 1

    def handle_endtag(self, tag):
        if tag == "div" and self._in_history:
            self._depth -= 1
            self._in_history = self._depth > 0

    def handle_data(self, data):
        if self._in_history:
            self.versions += [int(v) for v in re.findall(r"\[v([1-9]\d*)\]", data)]


def _head(html: str) -> _Head:
    parser = _Head()
    parser.feed(html)
    parser.close()
    return parser


def page_title(html: str, identifier: str) -> str | None:
    """HT1: the only title of a page's head, if the only id there is the one asked for."""
    meta = _head(html).meta
    titles, ids = ([re.sub(r"\s+", " ", v).strip() for n, v in meta if n == name] for name in ("citation_title", "citation_arxiv_id"))
    base = lambda v: re.sub(r"v\d+$", "", v.lower())
    return titles[0] if len(titles) == len(ids) == 1 and titles[0] and base(ids[0]) == base(identifier) else None


def history_versions(html: str) -> list[int]:
    """HT2: versions of a page's submission history, ascending."""
    return sorted(set(_head(html).versions))
