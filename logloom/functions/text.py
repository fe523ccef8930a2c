"""Text expressions: whitespace, normalization, samples, redaction, snippets and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class of the source logs' text rules (Unicode spaces, NBSP, BOM included).
WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NOT_WS = "[^" + WS[1:]

# Redaction patterns of public audit text.
HOME_PATH = r"/Users/[^/\s`]+"
EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PROVIDER_TOKEN = r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,}|github_pat_[A-Za-z0-9_]{20,})\b"
SECRET_PAIR = r"""\b(password|api[_-]?key|token|secret)\s*[:=]\s*("[^"]*"|'[^']*'|[^\s`]+)"""
REDACTED = "[redacted]"

_WORD = r"\w"  # ASCII letters, digits and _ on the JVM, tested at once; a class of ranges is tested range by range
_BOUNDARY = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Give a plain pattern its source meaning on the JVM.

    Word boundaries are ASCII, ``\\s`` is the Unicode class above, ``$`` is the very end of the text and
    ``.`` stops only at line feeds.  Patterns contain no escaped backslashes, which keeps this a textual rule.
    """
    out = pattern
    if out.startswith(r"\b("):
        out = rf"(?<!{_WORD})" + out[2:]
    out = out.replace(r"\b", _BOUNDARY)
    out = out.replace(r"[^\s`", "[^" + WS[1:-1] + "`").replace(r"[^/\s`", "[^/" + WS[1:-1] + "`")
    out = out.replace(r"\s", WS)
    if out.endswith("$"):
        out = out[:-1] + r"\z"
    return ("(?id)" if ignore_case else "(?d)") + out


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}++|(?<!{WS}){WS}++\z", "")


def collapse_ws(c: Column) -> Column:
    """Trim, and turn every whitespace run into one space.

    Runs that are one space already are not matched, and printable ASCII is told by its range, which spares most of the work.
    """
    return F.trim(F.regexp_replace(c, rf"[\x00-\x1f\x{{a0}}-\x{{10ffff}}&&{WS}]{WS}*+| {WS}++", " "))


def normalize_text(c: Column) -> Column:
    return F.lower(collapse_ws(c))


def compact(c: Column, limit: int) -> Column:
    """Collapsed text, cut to ``limit`` characters including the dots."""
    flat = collapse_ws(c)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def display_text(content: Column, source_event: Column) -> Column:
    trimmed = js_trim(content)
    return F.when(trimmed == "", source_event).otherwise(trimmed)


def redact_text(c: Column) -> Column:
    """Home paths, e-mail addresses, provider tokens and secret assignments.

    The e-mail pattern may only start at the start of a run (or where the last match ended); inner starts of
    the same run can never match when its start does not, so this changes the cost, not the result.
    """
    run = "[A-Z0-9._%+-]"
    out = F.regexp_replace(c, java_regex(HOME_PATH), "~")
    out = F.regexp_replace(out, rf"(?i)(?:(?<!{run})|\G){EMAIL}", "[redacted-email]")
    out = F.regexp_replace(out, java_regex(PROVIDER_TOKEN), "[redacted-token]")
    return F.regexp_replace(out, java_regex(SECRET_PAIR, ignore_case=True), "$1=[redacted-secret]")


def redact_inline(c: Column) -> Column:
    return collapse_ws(redact_text(c))


def sanitize_snippet(c: Column) -> Column:
    return collapse_ws(F.regexp_replace(c, rf"/Users/[^/{WS[1:-1]}]+/", "~/"))


def blockquote(c: Column) -> Column:
    """Markdown quote of a text; empty text gets a placeholder."""
    trimmed = js_trim(c)
    lines = F.transform(
        F.split(trimmed, r"\r?\n"),
        lambda line: F.when(F.length(line) > 0, F.concat(F.lit("> "), line)).otherwise(F.lit(">")),
    )
    return F.when(trimmed == "", F.lit("> [empty message]")).otherwise(F.array_join(lines, "\n"))


def quote_key(c: Column) -> Column:
    """Comparable form of a quote block: markers removed, blanks collapsed."""
    bare = F.array_join(F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(x, rf"\A>{WS}?", "")), "\n")
    return F.regexp_replace(js_trim(bare), r"[ \t]+", " ")


def _quoted(text: str) -> str:
    return "".join(ch if ch.isalnum() and ch.isascii() or ord(ch) > 127 else "\\" + ch for ch in text)


def query_pattern(query: str) -> str:
    """Regex for a normalized query inside text whose whitespace is not normalized."""
    return (WS + "+").join(_quoted(part) for part in normalize_query(query).split(" "))


def normalize_query(query: str) -> str:
    return " ".join(query.replace(chr(0xFEFF), " ").split()).lower()


def snippet(content: Column, query: str, width: int = 240, lead: int = 32) -> Column:
    """Window of the trimmed text that starts ``lead`` characters before the first match."""
    trimmed = js_trim(content)
    if not normalize_query(query):
        start = F.lit(0)
    else:
        at = F.regexp_instr(F.lower(trimmed), F.lit(query_pattern(query)))
        start = F.when(at > 0, F.greatest(F.lit(0), at - 1 - lead)).otherwise(F.lit(0))
    body = F.substring(trimmed, start + 1, F.lit(width))
    return F.concat(
        F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
        body,
        F.when(start + width < F.length(trimmed), F.lit("...")).otherwise(F.lit("")),
    )


def _sha(c: Column, size: int) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, size)


def repeated_id(group_key: Column) -> Column:
    return _sha(group_key, 16)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def eval_id(file_path: Column, session_id: Column, line: Column, turn_id: Column, timestamp: Column,
            content: Column) -> Column:
    return _sha(F.concat_ws("\0", *[_text(c) for c in (file_path, session_id, line, turn_id, timestamp, content)]), 24)


def session_marker(file_path: Column, session_id: Column) -> Column:
    return _sha(F.concat_ws("\n", file_path, session_id), 16)


def search_result_id(*parts: Column) -> Column:
    return F.concat_ws("#", *[_text(p) for p in parts])


def provider_label(source_label: Column, provider: Column) -> Column:
    named = (F.when(provider == "codex", "Codex").when(provider == "claude", "Claude Code")
             .when(provider == "cursor", "Cursor").otherwise(provider))
    return F.coalesce(F.nullif(source_label, F.lit("")), named)
