"""Text renderings and measures as columns, all JVM-side."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from packloom import constants as K
from packloom.functions.paths import let


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a constant map, null when missing."""
    flat = [item for pair in mapping.items() for item in pair]
    quoted = ", ".join("'" + item.replace("\\", "\\\\").replace("'", "\\'") + "'" for item in flat)
    return F.try_element_at(F.expr(f"map({quoted})"), key)


def detect_language(ext: Column) -> Column:
    return F.coalesce(lookup(K.LANGUAGE_BY_EXTENSION, F.lower(ext)), F.lit("UNKNOWN"))


def language_family(language: Column) -> Column:
    """JVM, SCRIPT, PYTHON, HTML, CSS or OTHER."""
    return (
        F.when(language.isin(K.JVM_LANGUAGES), F.lit("JVM"))
        .when(language.isin(K.SCRIPT_LANGUAGES), F.lit("SCRIPT"))
        .when(language.isin("PYTHON", "HTML", "CSS"), language)
        .otherwise(F.lit("OTHER"))
    )


def _utf16(content: Column, order: str) -> Column:
    """The text behind a two-byte mark; null if it is not whole and well-formed UTF-16."""
    units = F.regexp_replace(F.hex(F.substring(content, F.lit(3), F.length(content))), "(..)(..)", "$1$2" if order == "BE" else "$2$1")
    # An odd last byte, or a surrogate without its other half.
    broken = (F.length(units) % 4 != 0) | units.rlike(r"^(?:[0-9A-F]{4})*?(?:D[89AB]..(?!D[C-F])|(?<!D[89AB]..)D[C-F])")
    return F.when(~broken, F.decode(F.substring(content, F.lit(3), F.length(content)), f"UTF-16{order}"))


def read_text(content: Column, path: Column) -> Column:
    """Text of a binary column; without content the marker that drops the row.

    A byte order mark tells UTF-8 (without the mark then) or UTF-16. The rest is UTF-8, unless it is not valid
    and has no character beyond ASCII that is: that is Latin-1. In other texts malformed bytes are replaced.
    """
    marker = F.concat(F.lit("// Error reading file: "), path)
    start = F.hex(F.substring(content, F.lit(1), F.lit(3)))
    marked = F.startswith(start, F.lit("EFBBBF"))
    text = F.when(marked, F.substring(content, F.lit(4), F.length(content))).otherwise(content).cast("string")
    valid = F.make_valid_utf8(text)
    one_byte = ~marked & ~F.is_valid_utf8(text) & ~F.rlike(valid, F.lit("[^\\x00-\\x7F\uFFFD]"))
    return F.coalesce(
        F.when(F.startswith(start, F.lit("FEFF")), _utf16(content, "BE")).when(F.startswith(start, F.lit("FFFE")), _utf16(content, "LE")),
        F.when(one_byte, F.decode(content, "ISO-8859-1")).otherwise(valid), marker,
    )


def number_lines(text: Column) -> Column:
    def numbered(lines: Column) -> Column:
        width = F.length(F.size(lines).cast("string"))
        return F.array_join(
            F.transform(
                lines,
                lambda line, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(": "), line),
            ),
            "\n",
        )

    tail = F.when(F.endswith(text, F.lit("\n")), F.lit("\n")).otherwise(F.lit(""))
    return F.concat(let(F.split(text, K.LINE_BREAK, -1), numbered), tail)


def is_error_text(text: Column) -> Column:
    return F.startswith(text, F.lit("// Error"))


def is_dropped(text: Column, line_numbers: bool) -> Column:
    """Rows that leave the export uncounted: unreadable, or empty without line numbers."""
    unreadable = is_error_text(text)
    return unreadable if line_numbers else unreadable | (text == "")


def prepared_text(text: Column, line_numbers: bool) -> Column:
    return F.when(is_error_text(text), text).otherwise(number_lines(text)) if line_numbers else text


_HEADER_BY_KEY = {key: prefix for prefix, keys in K.HEADER_KEYS.items() for key in keys}


def header_prefix(ext: Column, name: Column) -> Column:
    return F.coalesce(
        lookup(_HEADER_BY_KEY, F.lower(ext)),
        lookup(_HEADER_BY_KEY, name),
        lookup(_HEADER_BY_KEY, F.lower(name)),
        F.lit(K.DEFAULT_HEADER),
    )


def has_header(text: Column) -> Column:
    plain = [p for p in K.HEADER_KEYS if not p.endswith("-->")]
    any_plain = "^(?:" + "|".join(re.escape(p) for p in plain) + ")"
    return text.rlike(any_plain) | text.rlike(K.HTML_HEADER_PATTERN)


def header_line(path: Column, ext: Column, name: Column) -> Column:
    prefix = header_prefix(ext, name)
    return F.when(
        F.endswith(prefix, F.lit("-->")),
        F.replace(prefix, F.lit("-->"), F.concat(path, F.lit(" -->"))),
    ).otherwise(F.concat(prefix, path))


def with_header(text: Column, path: Column, ext: Column, name: Column) -> Column:
    return F.when(has_header(text), text).otherwise(
        F.concat(header_line(path, ext, name), F.lit("\n"), text)
    )


def without_first_line(text: Column) -> Column:
    """Text after the first line feed, the whole text when there is none."""
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text)


def fence_hint(path: Column) -> Column:
    """The extension is taken from the whole path, so a dot in a directory name counts."""
    ext = F.when(F.instr(path, ".") > 0, F.lower(F.substring_index(path, ".", -1))).otherwise(F.lit(""))
    name = F.substring_index(path, "/", -1)
    by_name = F.coalesce(lookup(K.FENCE_HINTS, name), lookup(K.FENCE_HINTS, F.lower(name)))
    by_ext = lookup(K.FENCE_HINTS, ext)
    return F.coalesce(F.when(ext != "", by_ext).otherwise(by_name), F.lit("text"))


def escape_xml(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def approx_tokens(text: Column) -> Column:
    """Approximate token count; the exact vocabulary is not part of the library.

    Words and groups of up to three digits shrink to one character, every other visible character is a
    token already, so the count is a length and no list of tokens is built.
    """
    marks = F.regexp_replace(text, r"[A-Za-z]+|[0-9]{1,3}", "x")
    return F.length(F.translate(marks, " \t\r\n\f\x0b", "")).cast("bigint")


def history_size(n_bytes: Column) -> Column:
    kb = n_bytes / F.lit(1024.0)
    return F.when(kb < 1024, F.format_string("%.1f KB", kb)).otherwise(
        F.format_string("%.1f MB", kb / F.lit(1024.0))
    )


def notice_size(n_bytes: Column) -> Column:
    mb = n_bytes / F.lit(1024.0 * 1024.0)
    return F.when(mb >= 1.0, F.format_string("%.1fMB", mb)).otherwise(
        F.format_string("%.1fKB", n_bytes / F.lit(1024.0))
    )


def grouped_number(n: Column) -> Column:
    return F.format_number(n, 0)


def export_line(files: Column, n_bytes: Column, tokens: Column) -> Column:
    return F.concat(
        files.cast("string"), F.lit(" files, "), history_size(n_bytes),
        F.lit(", ~"), grouped_number(tokens), F.lit(" tokens"),
    )


def is_valid_filter(text: Column) -> Column:
    return text.rlike(r"^\.?\w+$")


# The sample is handled as separated hex bytes, "41 42 C3 A9 ", so that a regex can walk it bytewise.
_CLEAN_BYTES = (
    r"(?:0[9AD]|[2-7][0-9A-F]) "
    r"|[CD][0-9A-F] [89AB][0-9A-F] "
    r"|E[0-9A-F] (?:[89AB][0-9A-F] ){2}"
    r"|F[0-7] (?:[89AB][0-9A-F] ){3}"
)


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def is_binary_content(content: Column) -> Column:
    """Binary test on the first 1024 bytes: a NUL, or more than 30 % suspicious bytes.

    Valid text without control characters cannot be binary (only a character cut off at the end of the
    sample would count), so almost every file is decided by the first test.
    """
    start = F.substring(content.cast("string"), 1, 1024)
    clean = F.is_valid_utf8(start) & ~start.rlike(_CONTROL)
    sample = F.hex(F.substring(content.cast("binary"), 1, 1024))
    body = F.regexp_replace(sample, "^(?:EFBBBF|FFFE|FEFF)", "")
    spaced = F.regexp_replace(body, "(..)", "$1 ")
    suspicious = F.length(F.regexp_replace(spaced, _CLEAN_BYTES, "")) / 3
    total = F.length(body) / 2
    return F.when(clean | (total == 0), F.lit(False)).otherwise(
        spaced.rlike("(?:^| )00 ") | (suspicious / total > F.lit(0.30))
    )
