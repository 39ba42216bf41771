"""Positions of regular-expression matches with Spark's own functions.

``regexp_extract_all`` gives the matches and ``split`` the pieces between them, both leftmost and
non-overlapping; running sums of their lengths are the positions, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sql_string(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


SPAN = "array<struct<from:int,to:int,value:string,before:string,after:string>>"
CHUNK = 128  # matches summed together


def bound(value: str, body: str, name: str = "x") -> str:
    """SQL of ``body`` with ``value`` evaluated once, under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def ends(lengths: str) -> str:
    """SQL of the running sums of an array of integers.

    Sums run inside chunks and over the chunks: appending to one array copies it each time, which
    a text with very many matches couldn't afford.
    """
    chunks = f"transform(sequence(0, (size(l) - 1) div {CHUNK}), k -> slice(l, k * {CHUNK} + 1, {CHUNK}))"
    running = "aggregate({}, array({}), (a, v) -> array_append(a, element_at(a, -1) + v))"
    totals = "transform(c, d -> aggregate(d, 0, (a, v) -> a + v))"
    inner = f"flatten(transform(c, (d, k) -> slice({running.format('d', 'o[k]')}, 2, size(d))))"
    return bound(lengths, bound(chunks, bound(running.format(totals, "0"), inner, "o"), "c"), "l")


def found(text: str, pattern: str, quick: str | None = None) -> str:
    """SQL of an array of structs (from, to, value, before, after) for the matches of ``pattern``
    in the column ``text``; before and after are the pieces beside the match. ``pattern`` has no
    empty match. ``quick`` is a condition without which nothing can match.
    """
    p = sql_string(pattern)
    test = quick or f"{text} rlike {p}"
    parts = f"named_struct('m', regexp_extract_all({text}, {p}, 0), 'p', split({text}, {p}, -1))"
    # Lengths of pieces and matches alternate; sums up to and with a match give its end.
    lengths = "zip_with(x.m, slice(x.p, 1, size(x.m)), (m, q) -> char_length(m) + char_length(q))"
    spans = (f"transform({ends(lengths)}, (e, i) -> named_struct('from', e - char_length(x.m[i]), 'to', e, "
             "'value', x.m[i], 'before', x.p[i], 'after', x.p[i + 1]))")
    none = f"CAST(array() AS {SPAN})"
    return f"CASE WHEN {test} THEN {bound(parts, f'CASE WHEN size(x.m) > 0 THEN {spans} ELSE {none} END')} ELSE {none} END"


def outside(spans: str, others: str) -> str:
    """SQL of the ``spans`` that overlap none of ``others``.

    Others are dealt to about as many equal stretches of the text as the root of their number, and
    a span looks at its own stretches alone.
    """
    width = "greatest(1, CAST(array_max(transform(x.o, b -> b.to)) / sqrt(size(x.o)) AS INT))"
    stretches = "transform(sequence(0, array_max(transform(x.o, b -> b.to)) div w), k -> filter(x.o, b -> b.to > k * w AND b.from < (k + 1) * w))"
    own = "slice(h, CAST(s.from div w AS INT) + 1, CAST((s.to - 1) div w - s.from div w AS INT) + 1)"
    free = f"filter(x.s, s -> NOT exists({own}, k -> exists(k, b -> b.from < s.to AND s.from < b.to)))"
    body = f"CASE WHEN size(x.s) = 0 OR size(x.o) = 0 THEN x.s ELSE {bound(width, bound(stretches, free, 'h'), 'w')} END"
    return bound(f"named_struct('s', {spans}, 'o', {others})", body)


def joined(spans: str) -> str:
    """SQL of ``kind:start:end`` of an array of structs (from, place, to, kind), by start, then place."""
    return f"array_join(transform(array_sort({spans}), s -> concat(s.kind, ':', s.from, ':', s.to)), ',')"


def tagged(spans: str, kind: str, place: int) -> str:
    """SQL: the spans with their kind; place orders kinds that start together."""
    return f"transform({spans}, s -> named_struct('from', s.from, 'place', {place}, 'to', s.to, 'kind', '{kind}'))"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)
