"""Quality rules, line-first.

Each line with a word is judged by itself.  Punctuation rules: it does not end like a
sentence (an end mark, then closing quotes or brackets at most), more than MAX_SYMBOLS of
its bytes are symbols, or half of its words or more are shouted (end in two marks).
Navigation rule: cells parted by bars or arrows; menu labels fall to the end mark too.
Boilerplate rules: one of PHRASES, words said over and over, or a copy of an earlier line.
But for PHRASES, a parameter with the usual phrases of the corpus's four languages, no
rule depends on a language.  Failing lines are removed; a document that then has lost more
than MAX_LOST of its words is rejected, and so is one that fails the base rules on its
whole text.

Words are runs of bytes other than U+0020 and U+0009..U+000D.  Base rules: fewer than
20 words, or more than 30 % of the words in 8-word windows that occur twice or more.

Defined results.  A null text is an empty one: no word, base rules failed.  Null
doc_ids pass through; repeated rows are judged each; lines are cut at U+000A only.
Windows are told apart by 64-bit hashes, lines by their bytes; PHRASES are found with A-Z
lower-cased.  A text without a line that has a word is rejected by the base rules.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import chunks
from llm.textkernel import mix, scan_words, shingles, text_bytes

MIN_WORDS = 20
MAX_REPEAT = 30
MAX_LOST = 0.5
MAX_SYMBOLS = 0.1
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_DROP_SYMBOLS = bytes(range(256)), b"#*$%&|<>"
_ENDING = re.compile("(?:[.!?:;]|…|。|！|？)(?:[\"')\\]}*_]|”|’|»)*\\Z".encode())
_SHOUTS = (b"!!", b"??", b"!?", b"?!")
PHRASES = tuple(
    x.encode()
    for x in (
        "all rights reserved", "privacy policy", "terms of use", "terms of service", "terms and conditions", "cookie policy", "uses cookies", "click here", "read more", "subscribe to",
        "sign up for", "enable javascript", "powered by", "follow us on", "lorem ipsum", "licensed under", "copyright (c)",
        "tous droits réservés", "politique de confidentialité", "mentions légales", "cliquez ici", "lire la suite",
        "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "klicken sie hier", "mehr lesen",
        "todos los derechos reservados", "política de privacidad", "aviso legal", "haga clic aquí", "leer más",
    )
)


def failing_line(line: bytes, words: list[bytes]) -> bool:
    """Whether the punctuation, navigation or boilerplate rules remove a line with a word (copies are told by clean_lines)."""
    if not _ENDING.search(words[-1]):
        return True
    if 2 * sum(w.endswith(_SHOUTS) for w in words) >= len(words) > 1:
        return True
    symbols = len(line) - len(line.translate(*_DROP_SYMBOLS))
    if symbols:
        if symbols > MAX_SYMBOLS * len(line):
            return True
        if line.count(b" | ") + line.count(b" > ") >= 2 and 4 * (line.count(b" | ") + line.count(b" > ")) >= len(words):
            return True
    if len(words) >= 4 and 2 * sum(map(eq, words, words[1:])) >= len(words):
        return True
    low = line.lower()
    return any(p in low for p in PHRASES)


def clean_lines(raw: bytes) -> tuple[list[bytes], int, int, int]:
    """(lines that stay, words in lines that go, words, lines equal to an earlier one)."""
    seen: set[bytes] = set()
    kept, lost, total, repeated = [], 0, 0, 0
    for line in raw.split(b"\n"):
        split = line.split()
        words = len(split)
        if words == 0:
            kept.append(line)
            continue
        total += words
        again = line in seen
        repeated += again
        seen.add(line)
        if again or failing_line(line, split):
            lost += words
        else:
            kept.append(line)
    return kept, lost, total, repeated


def measure(batch: pa.RecordBatch):
    """(words, word_chars, symbols, words in repeated windows) for each row."""
    data, offs = text_bytes(batch.column(batch.schema.get_field_index("text")))
    starts, ends, h, at = scan_words(data, offs)
    rows = len(offs) - 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    in_words = np.concatenate(([0], np.cumsum(points[ends] - points[starts])))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    win = shingles(h, WINDOW)
    repeats = np.zeros(rows, np.int64)
    if len(win):
        row = np.repeat(np.arange(rows), np.diff(at))[: len(win)]
        place = np.flatnonzero(np.arange(len(win)) + WINDOW <= at[row + 1])
        key = mix(win[place] ^ mix(row[place].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, place[twice], 1)
        np.add.at(cover, place[twice] + WINDOW, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
        repeats = covered[at[1:]] - covered[at[:-1]]
    return np.diff(at), in_words[at[1:]] - in_words[at[:-1]], symbols[offs[1:]] - symbols[offs[:-1]], repeats


def _judge(batch: pa.RecordBatch):
    words, chars, symbols, repeats = measure(batch)
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT * words)
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    lines = [clean_lines((t or "").encode()) for t in texts]
    lost = np.array([x[1] for x in lines], np.int64)
    kept = ~failed & (lost <= MAX_LOST * words)
    return words, chars, symbols, repeats, failed, kept, lines


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words) for each row."""
    shape = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long"
    names = [x.split()[0] for x in shape.split(", ")]

    def judge(batches):
        for batch in chunks(batches, "text"):
            words, chars, symbols, repeats, failed, kept, lines = _judge(batch)
            cols = [batch.column(0).cast(pa.int64()), words, chars, symbols, np.array([x[3] for x in lines], np.int64), repeats, failed, kept, np.array([x[1] for x in lines], np.int64)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, shape)


def clean(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with failing lines removed from text; n_chars, if there is one, follows the new text."""
    schema = docs.schema

    def judge(batches):
        for batch in chunks(batches, "text"):
            *_, kept, lines = _judge(batch)
            if not kept.any():
                continue
            batch = batch.filter(pa.array(kept))
            texts = [b"\n".join(x[0]).decode() for x, k in zip(lines, kept.tolist()) if k]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            at = batch.schema.get_field_index("n_chars")
            if at >= 0 and pa.types.is_integer(batch.schema.field(at).type):
                batch = batch.set_column(at, batch.schema.field(at), pa.array([len(t) for t in texts], batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(judge, schema)
