"""Rows that fail to parse: finite-state tokenizers over raw records.

A record is cut into chunks of bytes. Chunks are independent: for every state a record might be in at a chunk's start
the automaton is run over the chunk, all chunks of a batch side by side, which gives the chunk's transition function.
The functions are composed along each record, so every chunk learns its true first state; a second run from that state
marks field ends and the byte at which an error begins. Records of any length cost the same per byte, and no record is
walked byte by byte in Python.

The same machinery runs two automata: delimited records (RFC 4180 quoting) and the lexical layer of JSON (RFC 8259).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass(frozen=True)
class Automaton:
    """``classes``: byte -> class (256); ``table``: [state, class] -> state; ``marks``: [state, class] -> True where the
    byte ends a token; ``error``: the absorbing error state; ``pad`` is the class that keeps every state."""

    classes: np.ndarray
    table: np.ndarray
    marks: np.ndarray
    start: int
    error: int

    @property
    def pad(self) -> int:
        return self.table.shape[1] - 1


#: States of a delimited record: at a field's first byte, in a bare field, in a quoted one, after a quote in a quoted one, failed.
FIRST, BARE, QUOTED, QUOTE, FAILED = range(5)


def delimited(comma: str = ",", quote: str = '"') -> Automaton:
    other, comma_class, quote_class, pad = range(4)
    classes = np.zeros(256, dtype=np.uint8)
    classes[ord(comma)], classes[ord(quote)] = comma_class, quote_class
    table = np.zeros((5, 4), dtype=np.uint8)
    table[FIRST] = [BARE, FIRST, QUOTED, FIRST]
    table[BARE] = [BARE, FIRST, FAILED, BARE]
    table[QUOTED] = [QUOTED, QUOTED, QUOTE, QUOTED]
    table[QUOTE] = [FAILED, FIRST, QUOTED, QUOTE]
    table[FAILED] = FAILED
    marks = np.zeros((5, 4), dtype=bool)
    marks[[FIRST, BARE, QUOTE], comma_class] = True
    return Automaton(classes, table, marks, FIRST, FAILED)


#: States of the JSON lexer: between tokens, in a string, after a backslash, four of \\u, failed. Numbers and literals are left to the grammar.
J_OUT, J_STRING, J_ESCAPE, J_U1, J_U2, J_U3, J_U4, J_FAILED = range(8)


def json_lexer() -> Automaton:
    """Fails at a byte that no JSON text can have at that place: a raw control character or a bad escape in a string,
    or, outside of strings, a byte that begins no token. A text that ends inside a string is left in a string state."""
    outside, word, quote, backslash, escape, hexa, hex_escape, u, control, space, pad = range(11)
    classes = np.full(256, word, dtype=np.uint8)
    classes[:32] = control
    for c in b"\t\n\r":
        classes[c] = space
    for c in b" ":
        classes[c] = outside
    for c in b"{}[]:,+-.":
        classes[c] = outside
    for c in b"0123456789ACDEFace":
        classes[c] = hexa
    for c in b"Bdbf":
        classes[c] = hex_escape
    classes[ord("B")] = classes[ord("d")] = hexa
    for c in b"nrt/":
        classes[c] = escape
    classes[ord('"')], classes[ord("\\")], classes[ord("u")] = quote, backslash, u
    table = np.full((8, 11), J_FAILED, dtype=np.uint8)
    for c in (outside, word, escape, hexa, hex_escape, u, space):
        table[J_OUT, c] = J_OUT
    table[J_OUT, quote] = J_STRING
    table[J_STRING] = J_STRING
    table[J_STRING, [quote, backslash, control, space]] = [J_OUT, J_ESCAPE, J_FAILED, J_FAILED]
    table[J_ESCAPE, [quote, backslash, escape, hex_escape]] = J_STRING
    table[J_ESCAPE, u] = J_U1
    for a, b in ((J_U1, J_U2), (J_U2, J_U3), (J_U3, J_U4), (J_U4, J_STRING)):
        table[a, [hexa, hex_escape]] = b
    table[:, pad] = np.arange(8)
    return Automaton(classes, table, np.zeros_like(table, dtype=bool), J_OUT, J_FAILED)


@dataclass
class Tokens:
    """Per record: last state, and the first failing byte (-1: none). Marks: record and byte offset of each token end."""

    state: np.ndarray
    failed_at: np.ndarray
    mark_record: np.ndarray
    mark_at: np.ndarray


def run(auto: Automaton, data: np.ndarray, offsets: np.ndarray, chunk: int = 512) -> Tokens:
    """Tokenize the records data[offsets[i]:offsets[i+1]] (bytes)."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    per = np.maximum((length + chunk - 1) // chunk, 1)
    first = np.concatenate([[0], np.cumsum(per)])
    record = np.repeat(np.arange(n), per)
    within = np.arange(first[-1]) - first[record]
    begin = offsets[record] + within * chunk
    size = np.clip(length[record] - within * chunk, 0, chunk)
    states = auto.table.shape[0]
    flat, width = auto.table.ravel(), auto.table.shape[1]
    entry = np.full(first[-1], auto.start, dtype=np.intp)
    longest = int(per.max()) if n else 0
    if longest > 1:
        # transition function of every chunk that is followed by another one: run from all states at once
        inner = np.where(within < per[record] - 1)[0]
        maps = np.tile(np.arange(states, dtype=np.intp), (len(inner), 1))
        for j in range(chunk):
            maps = flat[maps * width + auto.classes[data[begin[inner] + j]][:, None]].astype(np.intp)
        place = np.full(first[-1], -1)
        place[inner] = np.arange(len(inner))
        # compose along each record, all records side by side
        for k in range(1, longest):
            now = first[:-1][per > k] + k
            entry[now] = maps[place[now - 1], entry[now - 1]]
    order = np.argsort(-size, kind="stable")
    state, fell = entry[order], np.full(len(order), -1, dtype=np.int64)
    sized, began = size[order], begin[order]
    live = np.searchsorted(-sized, -np.arange(int(sized[0]) if len(sized) else 0), side="left")
    where, at = [], []
    for j, m in enumerate(live):
        cls = auto.classes[data[began[:m] + j]]
        key = state[:m] * width + cls
        hit = np.where(auto.marks.ravel()[key])[0]
        if len(hit):
            where.append(hit)
            at.append(began[hit] + j)
        after = flat[key].astype(np.intp)
        new = np.where((after == auto.error) & (state[:m] != auto.error))[0]
        fell[new] = began[new] + j
        state[:m] = after
    final = np.empty_like(state)
    final[order] = state
    failed = np.full(len(order), -1, dtype=np.int64)
    failed[order] = fell
    failed_at = np.full(n, -1, dtype=np.int64)
    bad = np.where(failed >= 0)[0]
    failed_at[record[bad]] = failed[bad] - offsets[record[bad]]
    if where:
        chunk_of, at_all = order[np.concatenate(where)], np.concatenate(at)
        by = np.lexsort((at_all, record[chunk_of]))
        mark_record, mark_at = record[chunk_of][by], (at_all - offsets[record[chunk_of]])[by]
    else:
        mark_record = mark_at = np.empty(0, dtype=np.int64)
    return Tokens(final[first[1:] - 1] if n else np.empty(0, dtype=np.intp), failed_at, mark_record, mark_at)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(1, dtype=np.uint8), offs
