"""What is sent to a translation service and what may come back: JSON payloads and XML transport. Plain functions of a segment."""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from texloom.tex.segment import MARKER, Segment, movable

# The service's names of languages and its limits.
TARGETS = {"zh-hans": "ZH-HANS", "zh-hant": "ZH-HANT", "en": "EN-US"}
REQUEST_BYTES = 128 * 1024
SHOWN = 512


def encode_xml(segment: Segment, literals: dict[str, str] | None = None) -> tuple[str | None, dict[str, str]]:
    """VL4: a segment as one element, its markers as elements of their own, and the text that each of these must keep.

    Movable spans of at most SHOWN characters are shown (literals maps macros to their text),
    all others by the marker's name.  A segment with characters that XML can't hold gives None.
    """
    shown, out, done = {}, [], 0
    for m in MARKER.finditer(segment.masked):
        name, value = m[0][1:-1], segment.protected[int(m[0][2:-1])]
        display = (literals or {}).get(value) or value
        shown[name] = display if movable(value) and len(display) <= SHOWN else name
        out += [escape(segment.masked[done : m.start()]), f'<ph id="{name}">{escape(shown[name])}</ph>']
        done = m.end()
    xml = "<p>" + "".join([*out, escape(segment.masked[done:])]) + "</p>"
    try:
        ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None, shown
    return xml, shown


def decode_xml(xml: str, shown: dict[str, str]) -> tuple[str | None, str | None]:
    """VL4: (masked text, None) if each element is there once with its text and nothing else is; or (None, error)."""
    if "<!" in xml or "<?" in xml:
        return None, "invalid_xml"
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError):
        return None, "invalid_xml"
    if root.tag != "p" or root.attrib:
        return None, "invalid_xml"
    found = [e.attrib.get("id", "") for e in root]
    kept = all(e.tag == "ph" and set(e.attrib) == {"id"} and not len(e) and shown.get(e.attrib["id"]) == (e.text or "") for e in root)
    if not kept or sorted(found) != sorted(shown):
        return None, "markers_changed"
    return (root.text or "") + "".join(f"⟪{i}⟫{e.tail or ''}" for i, e in zip(found, root)), None


def payload(segment: Segment, context: str | None = None, surrounding: str = "", feedback: str = "", literals: dict[str, str] | None = None) -> str:
    """EX2: the JSON of a paragraph's request: its masked text, what movable markers stand for, and the others in their order.

    A context of None is left out, as is an empty surrounding; the instructions beside the payload are the caller's.
    """
    names = [f"⟪P{n:04d}⟫" for n in range(len(segment.protected))]
    moves = {n: movable(v) for n, v in zip(names, segment.protected)}
    spans = dict(zip(names, segment.protected))
    readable = lambda v: len(v) < 150 and "%" not in v and re.search(r"[A-Za-z0-9]", v)
    fields = {
        "paper_context": context, "paragraph": segment.masked, "surrounding_source": surrounding or None,
        "value_tokens": {n: ((literals or {}).get(v) or v)[:350] for n, v in spans.items() if moves[n]},
        "fixed_format_order": [n for n in names if not moves[n]],
        "fixed_text_context": {n: v for n, v in spans.items() if not moves[n] and readable(v)},
        "previous_validation_error": feedback,
    }
    return json.dumps({k: v for k, v in fields.items() if v is not None}, ensure_ascii=False)


def xml_body(texts: list[str], target: str, context: str = "", source: str = "", glossary: str = "") -> tuple[str | None, str | None]:
    """EX4: (JSON body, None) of a request with XML texts; above the size the service takes, (None, "too_large")."""
    body = {"text": texts, "target_lang": TARGETS[target], "tag_handling": "xml", "tag_handling_version": "v2", "ignore_tags": ["ph"], "split_sentences": "nonewlines", "preserve_formatting": True, "show_billed_characters": True}
    body |= {k: v for k, v in {"context": context, "source_lang": source, "glossary_id": glossary}.items() if v}
    encoded = json.dumps(body, ensure_ascii=False)
    return (encoded, None) if len(encoded.encode()) <= REQUEST_BYTES else (None, "too_large")
