"""Prompts: templates with placeholders, filled once a run and once a paper."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.registry import prompt_block

#: {{NAME}} is filled once a run, {{ input.field }} from each paper's columns.
PASSAGES = """Find the datasets that the paper below refers to.

A reference names one published dataset by its accession, record number or DOI.

Paper: {{ input.paper_id }} (DOI {{ input.paper_doi }}, PMCID {{ input.pmcid }}, PMID {{ input.pmid }})
Title: {{ input.title }}

Passages that may name datasets:

{{ input.candidate_passages }}

Repositories and how their identifiers begin:
{{REPOSITORIES}}

Rules:
- Give only identifiers that stand in the passages, letter by letter; the list above is for recognising them.
- If no passage names an identifier or a repository, give an empty list.
- Answer with a list of objects: dataset_identifier, repository, evidence (the words that name it), confidence (high, medium or low), notes.
"""
FULL_TEXT = PASSAGES.replace("Passages that may name datasets:", "Full text:").replace("{{ input.candidate_passages }}", "{{ input.full_text }}").replace("in the passages", "in the text").replace("no passage names", "the text names neither").replace(" an identifier or a repository,", " an identifier nor a repository,")
_FIELD = re.compile(r"\{\{\s*input\.(\w+)\s*\}\}")


def render(template: str, values: dict[str, str]) -> str:
    """The template with each {{NAME}} of values replaced; other placeholders stay."""
    for name, value in values.items():
        template = template.replace("{{" + name + "}}", value)
    return template


def fields(template: str) -> list[str]:
    """The paper columns that a template names, each once, in order."""
    return list(dict.fromkeys(_FIELD.findall(template)))


def prompt(template: str, columns: list[str]) -> Column:
    """The template filled from a paper's columns; columns that are null or missing are empty."""
    parts = _FIELD.split(template)
    filled = [(F.coalesce(F.col(x).cast("string"), F.lit("")) if x in columns else F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)]
    return F.concat(*filled)


def with_prompt(papers: DataFrame, template: str = PASSAGES, name: str = "prompt", **values: str) -> DataFrame:
    """papers and a column with the prompt of each; {{REPOSITORIES}} is the registry's list."""
    return papers.withColumn(name, prompt(render(template, {"REPOSITORIES": prompt_block()} | values), papers.columns))
