"""Functions over notes, tool output and responses: frontmatter, tables, payloads, warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD = "title string, summary string, facts array<string>, open_ends array<string>"
SUMMARY_CHARS = 220
#: Warnings that say nothing about an answer's quality.
ROUTINE_WARNINGS = ("no_matches", "retrieval_candidate_limit_reached", "linked_parent_deduplicated", "unresolved_indexed_link", "unsafe_link_ignored", "invalid_note_path", "dense_matrix_stale_rebuilding")


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"^[\x22']+|[\x22']+$", "")


def retirement(text: Column) -> Column:
    """A note's ``retired:`` block as a struct of terms, since, replaced_by; null without terms or an
    ISO day."""
    block = F.regexp_extract(text, r"(?m)^retired:[ \t]*\n((?:[ \t]+[a-z_]+:.*\n?)+)", 1)

    def field(name: str) -> Column:
        return _unquoted(F.regexp_extract(block, rf"(?m)^[ \t]+{name}:[ \t]*(.*?)[ \t]*$", 1))

    terms = F.filter(F.transform(F.split(F.regexp_replace(field("terms"), r"^\[|\]$", ""), ","), _unquoted), lambda t: t != "")
    found = F.struct(terms.alias("terms"), field("since").alias("since"), field("replaced_by").alias("replaced_by"))
    return F.when((F.size(terms) > 0) & field("since").rlike(r"^\d{4}-\d{2}-\d{2}$"), found)


def page_descriptor(text: Column, path: Column) -> Column:
    """Title and summary of a note's frontmatter, or its path."""
    block = F.regexp_extract(text, r"^[^-]*---([\s\S]*?)---", 1)
    title = _unquoted(F.regexp_extract(block, r"(?m)^title:(.*)$", 1))
    raw = F.regexp_extract(block, r"(?m)^summary:((?:.*)(?:\n(?![A-Za-z]).*)*)", 1)
    summary = F.substring(_unquoted(F.regexp_replace(F.trim(raw), r"\s+", " ")), 1, SUMMARY_CHARS)
    name = F.when(title != "", title).otherwise(path)
    return F.when(summary != "", F.concat(name, F.lit(" -- "), summary)).otherwise(name)


def table_cells(line: Column) -> Column:
    """Cells of a markdown table line; a bar after an odd number of backslashes is part of its cell."""
    marked = F.regexp_replace(line, r"((?:^|[^\\])(?:\\\\)*)\\\|", "$1\\\\\x01")
    return F.transform(F.split(marked, r"\|"), lambda c: F.replace(c, F.lit("\x01"), F.lit("|")))


def loose_json(text: Column, schema: str) -> Column:
    """JSON with bare control characters and stray backslashes as well; null if it is none."""
    repaired = F.regexp_replace(text, r"\\(?![\x22\\/bfnrtu])", r"\\\\\\\\")
    return F.from_json(repaired, schema, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"})


def payload(text: Column) -> Column:
    """A synthesis payload with its texts and lists trimmed and blanks left out; null if a text is
    missing or blank, a list is missing, or there is an unknown key."""
    value = loose_json(text, PAYLOAD)
    known = F.size(F.array_except(F.json_object_keys(text), F.array(*(F.lit(k) for k in ("title", "summary", "facts", "open_ends"))))) == 0
    clean = lambda a: F.filter(F.transform(a, lambda t: F.trim(t)), lambda t: t != "")
    whole = (F.trim(value["title"]) != "") & (F.trim(value["summary"]) != "") & value["facts"].isNotNull() & value["open_ends"].isNotNull()
    return F.when(known & whole, F.struct(F.trim(value["title"]).alias("title"), F.trim(value["summary"]).alias("summary"), clean(value["facts"]).alias("facts"), clean(value["open_ends"]).alias("open_ends")))


def degraded(warnings: Column) -> Column:
    """Whether a response carries a warning that is not routine."""
    return F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: ~w.isin(*ROUTINE_WARNINGS))


def source_identity(conversation_id: Column) -> Column:
    return F.regexp_replace(conversation_id, "^synthesis/", "")
