"""Names of C tokens: keywords, punctuators, and the column expressions that classify lexemes."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Keywords of C23, in the order of the standard, then the prefixed spellings.
C23_KEYWORDS = (
    "auto break case char const constexpr continue default do double else enum extern float for goto if inline int long "
    "register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while "
    "alignas alignof bool false nullptr static_assert thread_local true typeof typeof_unqual "
    "_Alignas _Alignof _Atomic _BitInt _Bool _Complex _Decimal32 _Decimal64 _Decimal128 _Generic _Imaginary _Noreturn _Static_assert _Thread_local"
).split()

# Keywords of common compilers, reserved in every mode.
EXTENSION_KEYWORDS = (
    "__attribute__ __attribute __asm__ __asm asm __inline__ __inline __signed__ __signed __volatile__ __volatile __const__ __const "
    "__restrict__ __restrict __typeof__ __typeof __alignof__ __alignof __extension__ __label__ __thread __auto_type "
    "__builtin_va_arg __builtin_va_list __builtin_offsetof __builtin_choose_expr __builtin_types_compatible_p __real__ __imag__ __complex__ "
    "__func__ __FUNCTION__ __PRETTY_FUNCTION__ __declspec __cdecl __stdcall __fastcall __thiscall __vectorcall __forceinline "
    "__int8 __int16 __int32 __int64 __ptr32 __ptr64 __unaligned __w64 __pragma _Nonnull _Nullable _Null_unspecified"
).split()

# Punctuators and their token names, longest first.
PUNCTUATORS = {
    "%:%:": "PUNC_HASH_HASH_ALT",
    "...": "PUNC_ELLIPSIS", "<<=": "PUNC_LSHIFT_ASSIGN", ">>=": "PUNC_RSHIFT_ASSIGN",
    "->": "PUNC_ARROW", "++": "PUNC_PLUS_PLUS", "--": "PUNC_MINUS_MINUS", "<<": "PUNC_LSHIFT", ">>": "PUNC_RSHIFT",
    "<=": "PUNC_LE", ">=": "PUNC_GE", "==": "PUNC_EQ", "!=": "PUNC_NE", "&&": "PUNC_AND_AND", "||": "PUNC_OR_OR",
    "+=": "PUNC_PLUS_ASSIGN", "-=": "PUNC_MINUS_ASSIGN", "*=": "PUNC_STAR_ASSIGN", "/=": "PUNC_SLASH_ASSIGN", "%=": "PUNC_PERCENT_ASSIGN",
    "&=": "PUNC_AMP_ASSIGN", "^=": "PUNC_CARET_ASSIGN", "|=": "PUNC_PIPE_ASSIGN", "##": "PUNC_HASH_HASH",
    "<:": "PUNC_LBRACKET_ALT", ":>": "PUNC_RBRACKET_ALT", "<%": "PUNC_LBRACE_ALT", "%>": "PUNC_RBRACE_ALT", "%:": "PUNC_HASH_ALT",
    "(": "PUNC_LPAREN", ")": "PUNC_RPAREN", "{": "PUNC_LBRACE", "}": "PUNC_RBRACE", "[": "PUNC_LBRACKET", "]": "PUNC_RBRACKET",
    ";": "PUNC_SEMI", ",": "PUNC_COMMA", ".": "PUNC_DOT", "?": "PUNC_QUESTION", ":": "PUNC_COLON", "=": "PUNC_ASSIGN",
    "+": "PUNC_PLUS", "-": "PUNC_MINUS", "*": "PUNC_STAR", "/": "PUNC_SLASH", "%": "PUNC_PERCENT", "&": "PUNC_AMP", "|": "PUNC_PIPE", "^": "PUNC_CARET",
    "~": "PUNC_TILDE", "!": "PUNC_BANG", "<": "PUNC_LT", ">": "PUNC_GT", "#": "PUNC_HASH", "@": "PUNC_AT", "\\": "PUNC_BACKSLASH",
}

STORAGE = "typedef extern static auto register thread_local _Thread_local __thread constexpr".split()
QUALIFIERS = "const volatile restrict _Atomic __const __const__ __volatile __volatile__ __restrict __restrict__".split()
FUNCTION_SPECIFIERS = "inline _Noreturn __inline __inline__ __forceinline".split()
TYPE_WORDS = (
    "void char short int long float double signed unsigned bool _Bool _Complex _Imaginary _BitInt struct union enum typeof typeof_unqual __typeof __typeof__ "
    "__signed __signed__ __int8 __int16 __int32 __int64 __auto_type __builtin_va_list __complex__ _Decimal32 _Decimal64 _Decimal128"
).split()
GCC_ATTRIBUTE, MSVC_ATTRIBUTE = ("__attribute__", "__attribute"), ("__declspec",)
ATTRIBUTE_OPENERS = (*GCC_ATTRIBUTE, *MSVC_ATTRIBUTE)
#: What begins a declaration after the body of a function.
DECLARATION_STARTS = (*STORAGE, *TYPE_WORDS, *QUALIFIERS, *FUNCTION_SPECIFIERS, *ATTRIBUTE_OPENERS, "__extension__")
ASM_WORDS = ("asm", "__asm", "__asm__")
ASSERT_WORDS = ("static_assert", "_Static_assert")

# Binary operators by binding strength, and those that group from the right.
PRECEDENCE = {
    ",": 1, **dict.fromkeys("= += -= *= /= %= <<= >>= &= ^= |=".split(), 2), "?": 3, "||": 4, "&&": 5, "|": 6, "^": 7, "&": 8,
    "==": 9, "!=": 9, "<": 10, "<=": 10, ">": 10, ">=": 10, "<<": 11, ">>": 11, "+": 12, "-": 12, "*": 13, "/": 13, "%": 13,
}
RIGHT_TO_LEFT = (2, 3)

_DIGITS, _HEX = "[0-9][0-9']*", "[0-9a-fA-F][0-9a-fA-F']*"
_EXPONENT = f"[eE][+-]?{_DIGITS}"
_FLOAT = (
    rf"0[xX](?:{_HEX}\.(?:{_HEX})?|\.{_HEX}|{_HEX})[pP][+-]?{_DIGITS}[fFlL]?"
    rf"|(?:(?:{_DIGITS})?\.{_DIGITS}(?:{_EXPONENT})?|{_DIGITS}\.(?:{_EXPONENT})?|{_DIGITS}{_EXPONENT})[fFlLdD]?[fFlL]?"
)
_INT = rf"(?:0[xX]{_HEX}|0[bB][01][01']*|0[0-7']*|[1-9][0-9']*)[uUlL]*[wWbBzZ]*[uUlL]*"
_QUOTED = r"""(?:[^{q}\\\n\r]|\\[\s\S])*+{q}"""

#: A sign before each header name, which mark_headers() puts in and unmarked() takes out; Unicode has no such character.
MARK = "\uffff"

#: Lexeme classes in the order in which they are tried; the last takes any other character.
CLASSES = {
    "line_cont": r"\\(?:\r\n|\n|\r)",
    "block_comment": r"/\*[\s\S]*?\*/",
    "open_comment": r"/\*[\s\S]*+",
    "line_comment": r"//[^\n\r]*+",
    "newline": r"\r\n|\n|\r",
    "space": r"[ \t\x0B\f]++",
    "header": rf"""{MARK}(?:<[^>\n\r]*+>|"[^"\n\r]*+")""",
    "raw_string": r"""(?:u8|u|U|L)?R"([^(]*+)\([\s\S]*?\)\1\"""",
    "string": r"(?:u8|u|U|L)?" + '"' + _QUOTED.format(q='"'),
    "char": r"(?:u8|u|U|L)?'" + _QUOTED.format(q="'"),
    "float": _FLOAT,
    "int": _INT,
    "word": r"[A-Za-z_$][A-Za-z0-9_$]*+",
    "punctuator": "|".join(re.escape(p) for p in PUNCTUATORS),
    "error": rf"{MARK}{MARK}|[\s\S]",
}
#: One match is one lexeme; together they cover every character.
LEXEME = "|".join(f"(?:{p})" for p in CLASSES.values())
#: A directive that names a header, up to the name, and the name.
HEADER_LINE = r"""((?:#|%:)[ \t]*+(?:include_next|include|embed)[ \t]*+)(<[^>\n\r]*+>|"[^"\n\r]*+")"""
#: Token names of literals and trivia by class.
LITERALS = {"int": "LIT_INT", "float": "LIT_FLOAT", "char": "LIT_CHAR", "string": "LIT_STRING", "header": "LIT_HEADER_NAME", "line_cont": "TRIVIA_LINE_CONT", "block_comment": "TRIVIA_BLOCK_COMMENT", "line_comment": "TRIVIA_LINE_COMMENT"}
BLANK = ("space", "newline")
TRIVIA = ("line_cont", "block_comment", "line_comment")


def mark_headers(source: Column) -> Column:
    """Source text with MARK before each header name, after any number of blanks; a MARK of its own is doubled."""
    doubled = F.replace(source, F.lit(MARK), F.lit(MARK + MARK))
    return F.regexp_replace(doubled, HEADER_LINE, f"$1{MARK}$2")


def unmarked(lexeme: Column) -> Column:
    """A lexeme of marked text as it was."""
    return F.when(lexeme.contains(MARK), F.regexp_replace(lexeme, f"{MARK}({MARK}?)", "$1")).otherwise(lexeme)


def class_of(lexeme: Column) -> Column:
    """The class of a lexeme that LEXEME has cut out of marked text, from its first characters; numbers alone need an expression."""
    first = F.substring(lexeme, 1, 1)
    letter = first.rlike("[A-Za-z_$]")
    quoted = lambda q: lexeme.contains(q)
    return (
        F.when((first == MARK) & ~lexeme.startswith(MARK * 2), "header")
        .when(first.isin(*" \t\x0b\f"), "space")
        .when(first.isin("\r", "\n"), "newline")
        .when(lexeme.isin(list(PUNCTUATORS)), "punctuator")
        .when(letter, F.when(quoted('"'), "string").when(quoted("'"), "char").otherwise("word"))
        .when(lexeme.rlike(r"^\.?[0-9]"), F.when(lexeme.rlike(f"^(?:{_INT})$"), "int").otherwise("float"))
        .when(lexeme.startswith("/*"), F.when(lexeme.endswith("*/") & (F.length(lexeme) > 3), "block_comment").otherwise("open_comment"))
        .when(lexeme.startswith("//"), "line_comment")
        .when(first == "\\", "line_cont")
        .when((first == '"') & (F.length(lexeme) > 1), "string")
        .when((first == "'") & (F.length(lexeme) > 1), "char")
        .otherwise("error")
    )


def keyword_name(word: str) -> str:
    return f"KW_{word.upper()}"


def token_name(lexeme: Column, kind: Column) -> Column:
    """The token name by class and spelling; words that no table knows are ID."""
    punctuators = F.create_map(*[F.lit(x) for pair in PUNCTUATORS.items() for x in pair])
    named = F.create_map(*[F.lit(x) for pair in LITERALS.items() for x in pair])
    return (
        F.when((kind == "word") & lexeme.isin(C23_KEYWORDS + EXTENSION_KEYWORDS), F.concat(F.lit("KW_"), F.upper(lexeme)))
        .when(kind == "word", "ID")
        .when(kind == "punctuator", punctuators[lexeme])
        .otherwise(named[kind])
    )
