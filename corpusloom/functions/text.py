"""Text functions over a string column: lines, white space, normal form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom import constants as K

WHITESPACE = "".join(chr(c) for c in K.WHITESPACE_CODEPOINTS)

# the same set as a Java character-class body
_WS_CLASS = "".join(f"\\x{{{c:x}}}" for c in K.WHITESPACE_CODEPOINTS)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def decode_text(content: Column) -> Column:
    """Strict UTF-8 text with LF line ends; NULL where the bytes are not UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.when(
        F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")
    ).otherwise(text)


def count_substring(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal; byte lengths keep it O(n)."""
    cut = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(word), F.lit("")))
    return (cut / len(word.encode())).cast("int")


def line_count(c: Column) -> Column:
    return count_substring(c, "\n") + F.lit(1)


def nonblank_line_count(c: Column) -> Column:
    # one match per line that has a visible character: it starts there and
    # runs to the end of the line
    return F.regexp_count(c, F.lit(f"[^{_WS_CLASS}][^\\n]*+"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{_WS_CLASS}]++"))


def normalize_code(c: Column) -> Column:
    """Stripped lines without blank and `#` lines: the identity used by dedup."""
    stripped = F.transform(lines(c), strip)
    kept = F.filter(stripped, lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    return F.array_join(kept, "\n")


def code_hash(c: Column) -> Column:
    return F.md5(normalize_code(c))


def short_path(path: Column) -> Column:
    """Last two components; a bare name stays as it is."""
    return F.substring_index(path, "/", -2)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(name: Column) -> Column:
    """Suffix with its dot, as written; empty for `Makefile` or `.profile`."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def clean_code(c: Column) -> Column:
    """Code as shown to a model: right-stripped, no blank ends, first 30 lines."""
    right_stripped = F.array_join(F.transform(lines(c), rstrip), "\n")
    body = F.btrim(right_stripped, F.lit("\n"))
    head = F.substring_index(body, "\n", K.PROMPT_CODE_LINES)
    return F.when(
        line_count(body) > K.PROMPT_CODE_LINES,
        F.concat(head, F.lit("\n" + K.TRUNCATION_MARKER)),
    ).otherwise(body)
