"""Prompts as column expressions. Values are put in at once, so text in one value is never read as another's place."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(template: str, **values: Column | str) -> Column:
    """The template with {name} replaced by each value."""
    parts = [F.coalesce(v if isinstance(v, Column) else F.lit(str(v)), F.lit("")) if (v := values.get(p[1:-1])) is not None and p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


FACET = """Here is a conversation.
<data>
{conversation}
</data>
Answer the question <question>{question}</question> about it in English, in two sentences at most, without names of people or firms and without judging anyone.
<answer> {prefill}"""
RECORD = """Sum up this record in one sentence between <summary> tags.
<data>
{record}
</data>
<summary>"""
CLUSTER = """These texts belong together:
<data>
{members}
</data>
These are near but don't belong:
<contrast>
{outsiders}
</contrast>
{criteria}
Say what the first have in common: <summary>two sentences</summary> <name>ten words at most</name>"""
HIGHER = """Groups and what they hold:
<data>
{clusters}
</data>
Propose exactly {n} broader names ({low} to {high} will do) as a numbered list in <answer> tags."""
DEDUP = """Names:
<data>
{names}
</data>
Merge those that mean the same and give at most {n} distinct ones as a numbered list in <answer> tags."""
ASSIGN = """Which of these fits best?
<choices>
{choices}
</choices>
The group:
<data>
{cluster}
</data>
Repeat the one that fits in <answer> tags."""
RENAME = """These groups are now one:
<data>
{children}
</data>
Sum it up: <summary>two sentences</summary> <name>ten words at most</name>"""


def facet(conversation: Column, question: Column, prefill: Column) -> Column:
    return filled(FACET, conversation=conversation, question=question, prefill=prefill)


def record(text: Column) -> Column:
    return filled(RECORD, record=text)


def cluster_name(members: Column, outsiders: Column, criteria: Column) -> Column:
    return filled(CLUSTER, members=F.array_join(members, "\n"), outsiders=F.array_join(outsiders, "\n"), criteria=criteria)


def higher_names(clusters: Column, n: Column) -> Column:
    """clusters: ARRAY of texts; n names asked, half to one and a half times as many allowed."""
    return filled(HIGHER, clusters=F.array_join(clusters, "\n"), n=n.cast("string"), low=F.floor(n * 0.5).cast("string"), high=F.floor(n * 1.5).cast("string"))


def dedup_names(names: Column, n: Column) -> Column:
    return filled(DEDUP, names=F.array_join(names, "\n"), n=F.floor(n * 1.5).cast("string"))


def assign(choices: Column, cluster: Column) -> Column:
    return filled(ASSIGN, choices=F.array_join(choices, "\n"), cluster=cluster)


def rename(children: Column) -> Column:
    return filled(RENAME, children=F.array_join(children, "\n"))
