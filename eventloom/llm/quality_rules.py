"""Line-first quality rules: lines are judged, failing lines removed, and documents that lose too much text rejected."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .common import documents

SYMBOLS = b"#*$%&|<>"
TERMINAL = b".!?:;\"')]"
#: Ends of sentences and quotations beyond ASCII.
TERMINAL_WIDE = ("…".encode(), "”".encode(), "»".encode(), "。".encode())
INNER = b".!?;:,"
BOILERPLATE = (b"all rights reserved", b"cookie policy", b"use of cookies", b"enable javascript", b"privacy policy", b"terms of use", b"terms of service", b"skip to content", b"click here", b"licensed under", b"is licensed under", b"released under", b"lorem ipsum")


@dataclass(frozen=True)
class Rules:
    """short_line: words under which a line must end in terminal punctuation; from there on any sentence
    punctuation will do. symbols_per_word: more symbols a word make a line navigation or noise. max_lost:
    share of a document's words that may go with its failing lines. min_words, max_repeat: base rules."""

    short_line: int = 8
    symbols_per_word: float = 0.2
    max_lost: float = 0.5
    min_words: int = 50
    max_repeat: int = 50


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_lines", pa.int64()), ("n_lines_removed", pa.int64()), ("lost_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean_text", pa.large_string())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_lines_removed long, lost_words long, base_failed boolean, kept boolean, clean_text string"


def _lut(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


IS_SYMBOL, IS_TERMINAL, IS_INNER = _lut(SYMBOLS), _lut(TERMINAL), _lut(INNER)


def later_copies(h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal in its group, has an earlier equal in its group)."""
    key = T.mix(h, group.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later = np.zeros(len(h), bool)
    later[order[1:][same]] = True
    some = later.copy()
    some[order[:-1][same]] = True
    return some, later


def failing_lines(buf, start, size, words_in, has_word, last_end, rules: Rules) -> np.ndarray:
    """Which lines with a word fail. last_end: where each line's last word ends."""
    end = start + size
    csum = lambda lut: np.concatenate([[0], np.cumsum(lut[buf], dtype=np.int64)])
    count = lambda c: c[end] - c[start]
    symbols, inner = count(csum(IS_SYMBOL)), count(csum(IS_INNER))
    tail = np.maximum(last_end - 1, 0)
    ends_well = np.zeros(len(start), bool)
    if len(buf):
        ends_well = IS_TERMINAL[buf[tail]]
        for i in np.flatnonzero(has_word & (buf[tail] >= 0x80)):
            ends_well[i] = bytes(buf[max(start[i], last_end[i] - 3) : last_end[i]]).endswith(TERMINAL_WIDE)
    bad = ~ends_well & ((words_in < rules.short_line) | (inner == 0))
    bad |= symbols > rules.symbols_per_word * words_in
    raw = T.LOWER[buf].tobytes()
    for phrase in BOILERPLATE:
        p = raw.find(phrase)
        while p >= 0:
            i = int(np.searchsorted(start, p, "right")) - 1
            if p + len(phrase) <= end[i]:
                bad[i] = True
            p = raw.find(phrase, p + 1)
    return bad & has_word


def judge(batch: pa.RecordBatch, rules: Rules, texts: bool) -> pa.RecordBatch:
    buf, offs = T.utf8(batch.column(1))
    words = T.Words(buf, offs)
    per = words.per_doc
    solid = ~T.IS_SPACE[buf]
    cs = lambda m: np.concatenate([[0], np.cumsum(m, dtype=np.int64)])
    span = lambda c: c[offs[1:]] - c[offs[:-1]]
    word_chars, symbols = span(cs(solid & T.IS_LEAD[buf])), span(cs(IS_SYMBOL[buf]))

    h, first, per_win = words.shingles(3)
    twice, _ = later_copies(h, np.repeat(np.arange(len(per)), per_win))
    marked = np.zeros(len(words.at) + 3, bool)
    for k in range(3):
        marked[first[twice] + k] = True
    repeat_words = T.by_doc(marked[: len(words.at)], per)

    start, size, per_line = T.lines(buf, offs)
    doc_of_line = np.repeat(np.arange(len(per)), per_line)
    cut = np.searchsorted(words.src, np.append(start, len(buf)))
    words_in = np.diff(cut)
    has_word = words_in > 0
    last_end = np.zeros(len(start), np.int64)
    if len(words.src):
        last = np.maximum(cut[1:] - 1, 0)
        last_end = np.where(has_word, words.src[last] + words.size[last], 0)
    held = np.flatnonzero(has_word)
    _, later = later_copies(T.xxh64(buf, start[held], size[held]), doc_of_line[held])
    dup_lines = np.bincount(doc_of_line[held[later]], minlength=len(per))

    bad = failing_lines(buf, start, size, words_in, has_word, last_end, rules)
    lost = T.by_doc(np.where(bad, words_in, 0), per_line)
    base_failed = (per < rules.min_words) | (100 * repeat_words > rules.max_repeat * per)
    kept = ~base_failed & (lost <= rules.max_lost * per)
    clean = pa.nulls(len(per), pa.large_string())
    if texts:
        clean = _without(batch, buf, offs, start, size, per_line, bad, kept)
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(x, np.int64)) for x in (per, word_chars, symbols, dup_lines, repeat_words, T.by_doc(has_word, per_line), T.by_doc(bad, per_line), lost)), pa.array(base_failed), pa.array(kept), clean], schema=OUT)


def _without(batch, buf, offs, start, size, per_line, bad, kept) -> pa.Array:
    """Texts of kept documents without their failing lines; texts that lose nothing stay as they are."""
    out = batch.column(1).to_pylist()
    first = np.cumsum(per_line) - per_line
    any_bad = T.by_doc(bad, per_line) > 0
    for d in np.flatnonzero(kept & any_bad):
        rows = range(first[d], first[d] + per_line[d])
        out[d] = b"\n".join(bytes(buf[start[i] : start[i] + size[i]]) for i in rows if not bad[i]).decode()
    for d in np.flatnonzero(~kept):
        out[d] = None
    return pa.array(out, pa.large_string())


def quality_rules(docs: DataFrame, rules: Rules = Rules(), texts: bool = True) -> DataFrame:
    """One row per row of `docs`: base counts, lines removed, verdict, and the cleaned text of kept documents.

    Null and empty texts have no words and fail the base rules. A null doc_id stays null. Repeated rows
    are judged each for itself. `texts=False` leaves clean_text null. An empty table gives no rows.
    """

    def run(batches):
        for b in T.slices(batches, limit=1 << 20):
            yield judge(b, rules, texts)

    return documents(docs).mapInArrow(run, DDL)


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their cleaned text and its length; all columns of `docs` kept.

    The text travels with its row, so no join is needed. An n_chars column, if there, is the
    length of the text that stays. Null, empty and long texts, repeated rows and empty tables are as in
    `quality_rules`; other columns come through untouched, under any name.
    """
    schema = docs.schema
    at = schema.fieldNames().index("text")
    ids = schema.fieldNames().index("doc_id")

    def run(batches):
        for b in T.slices(batches, limit=1 << 20):
            got = judge(pa.RecordBatch.from_arrays([b.column(ids), b.column(at)], names=["doc_id", "text"]), rules, True)
            text = got.column(got.schema.get_field_index("clean_text")).cast(b.schema.field(at).type)
            kept = got.column(got.schema.get_field_index("kept"))
            columns = [text if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(kept)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))
    return out.select(docs.columns)
