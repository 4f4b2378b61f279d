"""``chunk_text(text, size)`` as a SQL table function.

A temporary SQL function over the chunkers' fold (C2/C3), written in SQL: the
plan of ``LATERAL chunk_text(..)`` holds one generator over native expressions
and no Python.
"""

from __future__ import annotations

from quire.functions.text import WS_CHARS, WS_CLASS


def _text(s: str) -> str:
    """``s`` as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _packed(parts: str, joiner: str, suffix: str, most: str) -> str:
    """SQL of the packing fold over an array: a part goes to the current chunk
    unless both are longer than ``size`` together."""
    out = f"array_append(a.out, concat(a.cur, {_text(suffix)}))"
    clean = f"filter(transform({parts}, p -> btrim(p, {_text(WS_CHARS)})), p -> p <> '')"
    return (f"aggregate({clean}, named_struct('cur', '', 'out', cast(array() as array<string>)), (a, x) -> "
            f"if(a.cur <> '' and length(a.cur) + length(x) > {most}, named_struct('cur', x, 'out', {out}), "
            f"named_struct('cur', if(a.cur <> '', concat(a.cur, {_text(joiner)}, x), x), 'out', a.out)), "
            f"a -> if(a.cur <> '', {out}, a.out))")


def chunk_text_sql(name: str = "chunk_text") -> str:
    """The statement that makes the function."""
    text, most = f"coalesce({name}.text, '')", f"coalesce({name}.size, 1000)"
    paragraphs = _packed(f"split({text}, {_text(chr(10) * 2)}, -1)", "\n\n", "", most)
    flat = f"replace({text}, {_text(chr(10))}, ' ')"
    sentences = _packed(f"split({flat}, {_text(r'\. ')}, -1)", " ", ".", most)
    # one element, so that the paragraphs are packed once and used three times
    chunks = (f"transform(array({paragraphs}), c -> if(size(c) = 0 or exists(c, x -> length(x) > 2 * {most}), "
              f"{sentences}, c))[0]")
    words = f"size(filter(split(content, {_text(WS_CLASS + '+')}, -1), w -> w <> ''))"
    return (f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING, size INT DEFAULT 1000) "
            f"RETURNS TABLE(chunk_index INT, content STRING, token_count INT) "
            f"RETURN SELECT chunk_index, content, {words} FROM posexplode({chunks}) AS t(chunk_index, content)")


def register_chunk_text(spark) -> None:
    spark.sql(chunk_text_sql())
