"""Scalar text functions over columns: cleaning and parsing of generated text, rendering of turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SUMMARY = "<Could not extract summary>"
NO_NAME = "<Could not extract name>"
_SPACE = r"[\s\x0B]"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+\z", "")


def strip_punctuation(c: Column) -> Column:
    """Off the end, once each and in this order: a full stop, a question mark, an exclamation mark; stripped between."""
    c = strip(c)
    for mark in (r"\.", r"\?", "!"):
        c = strip(F.regexp_replace(c, mark + r"\z", ""))
    return c


def tag_value(c: Column, tag: str) -> Column:
    """STRUCT<found, value>: what stands between the first <tag> and the next </tag>, whatever their case.

    Without the opening tag the value starts at the beginning, without the closing one it goes to the end;
    found needs both.
    """
    low, start, end = F.lower(c), f"<{tag.lower()}>", f"</{tag.lower()}>"
    at = F.instr(low, start)
    rest = F.when(at > 0, F.substring(c, at + len(start), F.length(c))).otherwise(c)
    to = F.instr(F.lower(rest), end)
    value = F.when(to > 0, F.substring(rest, F.lit(1), to - 1)).otherwise(rest)
    return F.struct(((at > 0) & (to > 0)).alias("found"), strip(value).alias("value"))


def facet_value(c: Column) -> Column:
    """The answer in a generated text; a closing summary tag is cut off as well."""
    return strip(F.regexp_replace(tag_value(c, "answer")["value"], r"(?is)</summary>.*\z", ""))


def strip_number(c: Column) -> Column:
    """Without the digits and dot that a list item begins with."""
    return strip(F.regexp_replace(strip(c), r"^[0-9]*\.", ""))


def numbered_list(c: Column, keep_open: bool = False) -> Column:
    """Items of the numbered list in <answer> tags; with keep_open, an unclosed answer gives all lines but the last."""
    t = tag_value(c, "answer")
    lines = F.filter(F.split(t["value"], "\n"), lambda x: strip(x) != "")
    items = F.transform(lines, strip_number)
    rest = F.when(F.size(items) > 0, F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))).otherwise(items) if keep_open else F.array().cast("array<string>")
    return F.when(t["found"], items).otherwise(rest)


def clean_trailing_tags(c: Column) -> Column:
    return strip(F.substring_index(strip(c), "</", 1))


def summary_name_pairs(c: Column) -> Column:
    """ARRAY<STRUCT<summary, name>> of all pairs after the last <summary>."""
    after = F.substring_index(c, "<summary>", -1)
    pattern = F.lit(r"(?s)(.*?)</summary>.*?<name>(.*?)</name>")
    pairs = F.arrays_zip(F.regexp_extract_all(after, pattern, F.lit(1)).alias("summary"), F.regexp_extract_all(after, pattern, F.lit(2)).alias("name"))
    return F.transform(pairs, lambda p: F.struct(strip_punctuation(p["summary"]).alias("summary"), strip_punctuation(p["name"]).alias("name")))


def summary_name(c: Column) -> Column:
    """STRUCT<summary, name>: the first of each that isn't empty, or a placeholder."""
    pairs = summary_name_pairs(c)
    pick = lambda k, default: F.coalesce(F.try_element_at(F.filter(F.transform(pairs, lambda p: p[k]), lambda x: x != ""), F.lit(1)), F.lit(default))
    return F.struct(pick("summary", NO_SUMMARY).alias("summary"), pick("name", NO_NAME).alias("name"))


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def name_summary(name: Column, summary: Column) -> Column:
    return F.concat_ws("\n", name, summary)


def render_turns(turns: Column) -> Column:
    """ARRAY<STRUCT<role, content, ...>> as role, colon and content on lines of their own."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":\n"), t["content"])), "\n")


def turns_json(turns: Column) -> Column:
    return F.to_json(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))


def duration(seconds: Column) -> Column:
    """Days to seconds in words; units of 0 are left out."""
    s = seconds.cast("long")
    parts = ((F.floor(s / 86400), "day", "  "), (F.floor(s / 3600) % 24, "hour", " "), (F.floor(s / 60) % 60, "minute", " "), (s % 60, "second", " "))
    return F.concat(*[F.when(n == 0, "").when(n == 1, F.concat(n.cast("string"), F.lit(f" {w}{gap}"))).otherwise(F.concat(n.cast("string"), F.lit(f" {w}s{gap}"))) for n, w, gap in parts])


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
