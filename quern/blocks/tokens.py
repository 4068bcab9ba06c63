"""Tokens of a block of units, as lexing.tokens() has them but for the trivia before each."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from ..functions import c_tokens as C
from .frame import Frame
from .values import Pool, Values

# Blanks, words that no quote follows, and marks that begin no longer lexeme are told first, as most lexemes are such; the rest in the order of the classes.
_CERTAIN = r"""[ \t\x0B\f]++|[A-Za-z_$][A-Za-z0-9_$]*+(?!["'])|[(){}\[\];,~?@]"""
_RAW = re.compile(f"{_CERTAIN}|{C.LEXEME}")
#: Without raw strings, whose pattern has a group.
_PLAIN = re.compile(f"{_CERTAIN}|" + "|".join(f"(?:{p})" for k, p in C.CLASSES.items() if k != "raw_string"))
_HEADER_LINE = re.compile(C.HEADER_LINE)
_MARKS = re.compile(f"{C.MARK}({C.MARK}?)")
_INT = re.compile(f"(?:{C.CLASSES['int']})")
_NUMBER = re.compile(r"\.?[0-9]")
_LETTER = re.compile("[A-Za-z_$]")
_KEYWORDS = frozenset(C.C23_KEYWORDS + C.EXTENSION_KEYWORDS)


def lexemes(source: str) -> list[str]:
    """Lexemes of a source, marked where they hold a MARK (see C.mark_headers())."""
    if C.MARK in source or "#" in source or "%:" in source:
        source = _HEADER_LINE.sub(rf"\1{C.MARK}\2", source.replace(C.MARK, C.MARK * 2))
    return [m[0] for m in _RAW.finditer(source)] if 'R"' in source else _PLAIN.findall(source)


def class_of(lexeme: str) -> str:
    """C.class_of()."""
    first = lexeme[0]
    if first == C.MARK and not lexeme.startswith(C.MARK * 2):
        return "header"
    if first in " \t\x0b\f":
        return "space"
    if first in "\r\n":
        return "newline"
    if lexeme in C.PUNCTUATORS:
        return "punctuator"
    if _LETTER.match(first):
        return "string" if '"' in lexeme else "char" if "'" in lexeme else "word"
    if _NUMBER.match(lexeme):
        return "int" if _INT.fullmatch(lexeme) else "float"
    if lexeme.startswith("/*"):
        return "block_comment" if lexeme.endswith("*/") and len(lexeme) > 3 else "open_comment"
    if lexeme.startswith("//"):
        return "line_comment"
    if first == "\\":
        return "line_cont"
    if first in "\"'" and len(lexeme) > 1:
        return "string" if first == '"' else "char"
    return "error"


def token_name(lexeme: str, kind: str) -> str | None:
    """C.token_name()."""
    if kind == "word":
        return C.keyword_name(lexeme) if lexeme in _KEYWORDS else "ID"
    return C.PUNCTUATORS.get(lexeme) if kind == "punctuator" else C.LITERALS.get(kind)


def _int(data: np.ndarray, ok: np.ndarray | None = None) -> Values:
    return Values("int", data, ok, len(data))


def tokens(sources: list[list[str | None]]) -> Frame:
    """Tokens of units, of which each has its sources in their order; unit_id is a unit's place."""
    cut, counts, units_of, nth_of = [], [], [], []
    for unit, own in enumerate(sources):
        for nth, source in enumerate(own):
            found = lexemes(source) if source else []
            cut += found
            counts.append(len(found))
            units_of.append(unit)
            nth_of.append(nth)
    spelled = pa.array(cut, pa.string()).dictionary_encode()
    del cut
    code, marked = spelled.indices.to_numpy().astype(np.int64), spelled.dictionary.to_pylist()
    pool = Pool()
    own = [_MARKS.sub(r"\1", w) if C.MARK in w else w for w in marked]
    cls_of = [class_of(w) for w in marked]
    names = [token_name(w, k) for w, k in zip(own, cls_of, strict=True)]
    table = lambda words: np.fromiter((pool.code(w) for w in words), np.int64, len(own))[code]
    number = lambda told: np.fromiter(map(told, own), np.int64, len(own))[code]
    src, cls, name = table(own), table(cls_of), table(n or "" for n in names)
    named = np.fromiter((n is not None for n in names), bool, len(own))[code]
    size, breaks, after = number(len), number(lambda w: w.count("\n")), number(lambda w: len(w) - w.rfind("\n") - 1)

    source = np.repeat(np.arange(len(counts)), counts)
    unit = np.asarray(units_of, np.int64)[source]
    first_of_source = (np.cumsum(counts) - counts)[source] if len(counts) else source
    at = np.arange(len(code))
    ix = (np.asarray(nth_of, np.int64)[source] << 32) + at - first_of_source
    new = np.concatenate([[True], unit[1:] != unit[:-1]]) if len(code) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, at, 0))

    def total(x: np.ndarray) -> np.ndarray:
        """Running sums in each unit."""
        sums = np.cumsum(x)
        return sums - (sums - x)[first]

    def latest(which: np.ndarray) -> np.ndarray:
        """The last place up to each where `which` holds, in its unit, else -1."""
        seen = np.maximum.accumulate(np.where(which, at, -1))
        return np.where(seen >= first, seen, -1)

    def before(places: np.ndarray) -> np.ndarray:
        return np.where(at > first, np.concatenate([[-1], places[:-1]]), -1) if len(places) else places

    end, line = total(size), total(breaks)
    start = end - size
    broken = before(latest(breaks > 0))
    begin = np.where(broken >= 0, (end - after)[np.maximum(broken, 0)], 0)
    is_cls = lambda k, *more: np.isin(cls, [pool.code(x) for x in (k, *more)])
    newline, space = is_cls("newline"), is_cls("space")
    ends_line = newline | is_cls("line_cont")
    lagged = lambda of, k, outside: np.where(at - first >= k, np.concatenate([np.zeros(k, bool), of[: len(of) - k]])[: len(of)], outside)
    hashes = np.isin(src, [pool.code("#"), pool.code("%:")])
    opens = hashes & (lagged(ends_line, 1, True) | lagged(space, 1, False) & lagged(ends_line, 2, True))
    opened, closed = latest(opens), before(latest(newline))
    inside = (opened >= 0) & (closed < opened)
    nth = total(opens.astype(np.int64))
    name = np.where(opens & inside, pool.code("PP_HASH"), np.where(newline & inside, pool.code("PP_NEWLINE"), name))
    named = named | inside & (opens | newline)

    pp_newline = named & (name == pool.code("PP_NEWLINE"))
    real = named & ~is_cls(*C.TRIVIA) & (~is_cls(*C.BLANK) | pp_newline)
    kept = np.flatnonzero(real | is_cls("error", "open_comment"))
    unit, ix, src, cls, name, named, start, end, begin, inside, nth = (x[kept] for x in (unit, ix, src, cls, name, named, start, end, begin, inside, nth))
    line = (1 + line - breaks)[kept]
    at = np.arange(len(kept))
    new = np.concatenate([[True], unit[1:] != unit[:-1]]) if len(kept) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, at, 0))
    has_prev = at > first
    has_next = np.append(has_prev[1:], False) if len(kept) else has_prev

    def depth(opening: str, closing: str) -> Values:
        step = np.where(inside, 0, (src == pool.code(opening)).astype(np.int64) - (src == pool.code(closing)))
        return _int(total(step) - (step == 1))

    words = lambda of, ok=None: Values("word", of, ok, len(of))
    shifted = lambda of, k: np.roll(of, k)
    cols = {
        "unit_id": _int(unit), "ix": _int(ix), "tok_ix": _int(at - first), "tname": words(name, named), "src": words(src), "cls": words(cls), "start": _int(start), "end": _int(end), "line": _int(line), "col": _int(1 + start - begin),
        "dir_id": _int(nth, inside), "braces": depth("{", "}"), "parens": depth("(", ")"), "brackets": depth("[", "]"),
        "prev": words(shifted(src, 1), has_prev), "next": words(shifted(src, -1), has_next), "prev_cls": words(shifted(cls, 1), has_prev),
    }
    return Frame(cols, len(kept), pool)
