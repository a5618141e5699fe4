"""What a model makes of a question before a search: a question that stands alone, a text to search by, constraints.

Each takes a Python function over one question, which runs in Arrow batches where the question is; where it fails or says nothing, the rules or the question itself take
its place, so that no question is lost. The defaults are deterministic stand-ins that need no model.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions import constraints as c

#: Takes a question and its history, (role, content) from old to new.
Condenser = Callable[[str, list[tuple[str, str]]], str]


def after_last_question(question: str, history: list[tuple[str, str]]) -> str:
    """Stand-in for a model that completes a question: the user's last question leads it."""
    said = [content for role, content in history if role == "user"]
    return f"{said[-1]} {question}" if said else question


def condensed(questions: DataFrame, model: Condenser = after_last_question, last: int = 6, shown: int = 300) -> DataFrame:
    """questions (query_id, text, history: array of role and content from old to new) with condensed: the question as one that stands alone.

    The model sees the `last` messages, `shown` characters of each; without history it isn't asked. Quotation marks around its answer go. A failing or
    blank answer: the question as it is. Null questions stay null.
    """

    @F.udf("string", useArrow=True)
    def run(question: str | None, history: list | None) -> str | None:
        if question is None or not history:
            return question
        try:
            answer = model(question, [(m["role"], m["content"]) for m in history])
            return (answer or "").strip().strip('"“”').strip() or question
        except Exception:  # one question's failure is its own
            return question

    recent = F.transform(F.slice("history", F.greatest(F.lit(1), F.size("history") - last + 1), F.lit(last)), lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), F.substring(F.coalesce(m["content"], F.lit("")), 1, shown).alias("content")))
    given = F.when(F.coalesce(F.size("history"), F.lit(0)) > 0, recent)
    return questions.withColumn("condensed", run(F.col("text"), given))


def hypothetical(questions: DataFrame, model: Callable[[str], str] = lambda question: question) -> DataFrame:
    """questions (query_id, text) with search_text: an answer that a model makes up, by whose vector the search goes. The question itself where the model fails or says nothing."""

    @F.udf("string", useArrow=True)
    def run(question: str | None) -> str | None:
        try:
            return question if question is None else (model(question) or "").strip() or question
        except Exception:
            return question

    return questions.withColumn("search_text", run(F.col("text")))


def official(department: Column, names: dict[str, str] = c.DEPARTMENTS) -> Column:
    """The full name of a department that a model names: of a known short name its full one, a full name itself, else of the first known name that is part of it or whose
    full name it is part of; what nothing fits stays."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    full = department.isin(list(dict.fromkeys(names.values())))
    near = F.coalesce(*[F.when(F.contains(department, F.lit(short)) | F.contains(F.lit(name), department), F.lit(name)) for short, name in names.items()])
    return F.when(F.trim(department) != "", F.coalesce(known[department], F.when(full, department), near, department))


def understood(questions: DataFrame, model: Callable[[str], str] | None = None, names: dict[str, str] = c.DEPARTMENTS) -> DataFrame:
    """questions (query_id, text) with year, department, category, semantic_query, source (rule, model, none).

    Rules come first; only a question in which they find nothing is put to the model, whose answer is to hold a JSON object with these fields. An answer without one,
    or a failing call, leaves the question without constraints. semantic_query: what the model says is left of the question, else the question.
    """

    @F.udf("string", useArrow=True)
    def asked(question: str | None) -> str | None:
        try:
            answer = model(question) if model is not None and question is not None else None
        except Exception:
            return None
        found = re.search(r"(?s)\{.*\}", answer or "")
        return found.group() if found else None

    year, department = c.year_in(F.col("text")), c.named_in(F.col("text"), names)
    ruled = questions.withColumn("__r", F.struct(year.alias("year"), department.alias("department")))
    by_rule = F.col("__r.year").isNotNull() | F.col("__r.department").isNotNull()
    said = ruled.withColumn("__m", F.from_json(asked(F.when(~by_rule, F.col("text"))), "year string, department string, category string, semantic_query string"))
    given = F.coalesce(F.col("__m.year"), F.col("__m.department"), F.col("__m.category"), F.col("__m.semantic_query")).isNotNull()
    stated = lambda name: F.nullif(F.trim(F.col(f"__m.{name}")), F.lit(""))
    return said.withColumns({
        "year": F.coalesce("__r.year", stated("year")), "department": F.coalesce(F.col("__r.department"), official(stated("department"), names)), "category": stated("category"),
        "semantic_query": F.coalesce(stated("semantic_query"), F.col("text")), "source": F.when(by_rule, "rule").when(given, "model").otherwise("none"),
    }).drop("__r", "__m")
