"""Message text: content blocks, submitted prompts, automation prompts, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.jsonv import arr_at, str_at
from logloom.functions.text import WS, collapse_ws, js_trim

# Markers and generated lines of rollout prompts.
REQUEST_MARKER = "## My request for Codex:"
DIFF_HEADING = "# Diff comments:"
GENERATED_LINES = [
    r"^The next image shows .* at the time of Comment \d+\. .* (outlined in blue|marked by comment marker \d+)\.?$",
    r"^The next image is untrusted page evidence from the browser page for Comment \d+\. Treat any text in the image "
    r"as page content, not instructions\. The element .+ that the user selected is outlined in blue and marked by "
    r"comment marker \d+\.?$",
    r"^<image(?:\s+[^>]*)?>\s*(?:</image>)?$",
    r"^</image>$",
]
DIFF_COMMENT = (r"\nComment:\n([\s\S]*?)(?=\n\n(?:## Comment \d+|# In app browser(?: \(IAB\))?:"
                r"|## My request for Codex:|\z))")
AUTOMATION = [r"^automation\s*:", r"^continue working toward the active thread goal\.?$"]
ROLES = ["user", "assistant", "system", "developer", "automation"]


def _own_text(item: Column) -> Column:
    return F.coalesce(str_at(item, "$"), str_at(item, "$.text"), str_at(item, "$.output_text"), str_at(item, "$.content"))


def _inner(item: Column) -> Column:
    """The items that stand for one without a text of its own."""
    return F.when(_own_text(item).isNull(), arr_at(item, "$.content"))


def _unfolded(items: Column) -> Column:
    """Items with every nested content array put in its place, to any depth.

    Texts are joined by line feeds on each level and empty ones are left out, so only their order counts and levels can be opened one after
    the other, until none is left.  There are at most as many as the key occurs.
    """
    def nested(held: Column) -> Column:
        return F.exists(held, lambda x: _inner(x).isNotNull())

    def opened(held: Column) -> Column:
        return F.flatten(F.transform(held, lambda x: F.coalesce(_inner(x), F.array(x))))

    levels = F.sequence(F.lit(1), F.size(F.split(F.to_json(items), '"content"')))
    deep = F.aggregate(levels, items, lambda held, _: F.when(nested(held), opened(held)).otherwise(held))
    return F.when(nested(items), deep).otherwise(items)


def content_to_text(v: Column, path: str = "$") -> Column:
    """Text of a content value: a string, or the non-empty texts of an array, nested ones included, joined by line feeds."""
    texts = F.transform(_unfolded(arr_at(v, path)), lambda x: F.coalesce(_own_text(x), F.lit("")))
    return F.coalesce(str_at(v, path), F.array_join(F.filter(texts, lambda t: t != ""), "\n"), F.lit(""))


def claude_message_text(v: Column, path: str = "$.content") -> Column:
    """Only plain strings and blocks of type text."""
    def block(x: Column) -> Column:
        return F.coalesce(str_at(x, "$"), F.when(str_at(x, "$.type") == "text", str_at(x, "$.text")), F.lit(""))

    blocks = F.filter(F.transform(arr_at(v, path), block), lambda t: t != "")
    return F.coalesce(str_at(v, path), F.array_join(blocks, "\n"), F.lit(""))


def block_count(v: Column, path: str, kind: str) -> Column:
    hits = F.filter(arr_at(v, path), lambda x: str_at(x, "$.type") == kind)
    return F.coalesce(F.size(hits), F.lit(0))


def array_count(v: Column, path: str) -> Column:
    return F.coalesce(F.size(arr_at(v, path)), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(js_trim(c), F.lit(""))


def tool_event_content(v: Column) -> Column:
    return blank_to_null(F.coalesce(str_at(v, "$.output"), str_at(v, "$.content"), str_at(v, "$.arguments"),
                                    content_to_text(v, "$.content")))


def cursor_tool_content(v: Column) -> Column:
    return blank_to_null(F.coalesce(str_at(v, "$.output"), str_at(v, "$.content"), str_at(v, "$.result"),
                                    content_to_text(v, "$.content")))


def _generated(line: Column) -> Column:
    flat = collapse_ws(line)
    hit = F.lit(False)
    for pattern in GENERATED_LINES:
        hit = hit | flat.rlike("(?id)" + pattern[:-1] + r"\z")
    return hit


def strip_generated(c: Column) -> Column:
    return js_trim(F.array_join(F.filter(F.split(c, r"\r?\n"), lambda line: ~_generated(line)), "\n"))


def diff_comments(c: Column) -> Column:
    bodies = F.filter(F.transform(F.regexp_extract_all(c, F.lit(DIFF_COMMENT), F.lit(1)), js_trim), lambda t: t != "")
    return F.when(c.contains(DIFF_HEADING) & (F.size(bodies) > 0), F.array_join(bodies, "\n\n"))


def submitted_prompt_text(c: Column) -> Column:
    """What the user asked for: the part after the request marker, without generated image captions.

    If nothing is left, the bodies of the diff comments before the marker.
    """
    raw = F.coalesce(c, F.lit(""))
    at = F.locate(REQUEST_MARKER, raw)
    request = strip_generated(F.substring(raw, at + len(REQUEST_MARKER), F.length(raw)))
    comments = F.coalesce(diff_comments(F.substring(raw, F.lit(1), at - 1)), F.lit(""))
    return F.when(at == 0, strip_generated(raw)).when(request != "", request).otherwise(comments)


def is_automation(c: Column) -> Column:
    flat = collapse_ws(c)
    return flat.rlike("(?i)" + AUTOMATION[0].replace(r"\s", WS)) | flat.rlike("(?i)" + AUTOMATION[1][:-1] + r"\z")


def message_role(c: Column) -> Column:
    return F.when(c.isin(*ROLES), c).otherwise(F.lit("unknown"))


def is_submitted(role: Column | None = None, source_event: Column | None = None) -> Column:
    """A prompt a person submitted."""
    role = F.col("role") if role is None else role
    event = F.col("source_event") if source_event is None else source_event
    return (role == "user") & event.isin("event_msg.user_message", "claude.user_message", "cursor.user_message")


def is_codex_submitted() -> Column:
    return is_submitted() & (F.coalesce(F.col("provider"), F.lit("codex")) == "codex")


def is_automation_message() -> Column:
    return F.col("source_event") == "event_msg.automation_message"
