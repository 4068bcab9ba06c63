"""SQL functions that return tables, so that SQL can take sources apart with LATERAL; lexing stays in the JVM.

    SELECT u.path, t.* FROM units u, LATERAL c_tokens(u.src) t
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import c_tokens as C


def _text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _class_of(lexeme: str) -> str:
    """The class of a lexeme: the first whose pattern is the whole of it, as an earlier one would have cut it otherwise."""
    whens = [f"WHEN {lexeme} RLIKE {_text(rf'^(?:{pattern})\z')} THEN {_text('string' if name == 'raw_string' else name)}" for name, pattern in C.CLASSES.items() if name != "error"]
    return f"CASE {' '.join(whens)} ELSE 'error' END"


def register_table_functions(spark: SparkSession) -> None:
    """Makes c_lexemes(src) and c_tokens(src) functions of the session.

    c_lexemes gives (ix, lexeme, cls), one row for each lexeme in order; together they are the source.
    c_tokens gives (ix, tname, lexeme) without blanks and trivia; a # that opens a directive is an
    ordinary one here, as directives need the lines of the whole unit. A null or empty source has none.
    """
    doubled = f"replace(src, {_text(C.MARK)}, {_text(C.MARK * 2)})"
    marked = f"regexp_replace({doubled}, {_text(C.HEADER_LINE)}, {_text(f'$1{C.MARK}$2')})"
    plain = f"regexp_replace(m, {_text(f'{C.MARK}({C.MARK}?)')}, '$1')"
    cut = f"regexp_extract_all({marked}, {_text(C.LEXEME)}, 0)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION c_lexemes(src STRING) RETURNS TABLE (ix INT, lexeme STRING, cls STRING) RETURN SELECT ix, {plain}, {_class_of('m')} FROM posexplode({cut}) AS t(ix, m)")
    names = lambda pairs: f"map({', '.join(_text(x) for pair in pairs.items() for x in pair)})"
    keywords = ", ".join(_text(w) for w in C.C23_KEYWORDS + C.EXTENSION_KEYWORDS)
    tname = f"CASE WHEN cls = 'word' AND lexeme IN ({keywords}) THEN concat('KW_', upper(lexeme)) WHEN cls = 'word' THEN 'ID' WHEN cls = 'punctuator' THEN {names(C.PUNCTUATORS)}[lexeme] ELSE {names(C.LITERALS)}[cls] END"
    skipped = ", ".join(_text(c) for c in (*C.BLANK, *C.TRIVIA))
    # A WHERE would make the call a join by the source's text; so lexemes are left out before the array is taken apart.
    kept = f"filter(transform({cut}, (m, i) -> named_struct('ix', i, 'lexeme', {plain}, 'cls', {_class_of('m')})), t -> t.cls NOT IN ({skipped}))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION c_tokens(src STRING) RETURNS TABLE (ix INT, tname STRING, lexeme STRING) RETURN SELECT ix, {tname}, lexeme FROM inline({kept}) AS t(ix, lexeme, cls)")
