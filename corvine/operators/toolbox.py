"""A registry of tools that an assistant may call: named table functions with argument schemas.

A table of calls (call_id, tool, arguments as a JSON object) is answered as a whole: each call is checked against its tool's schema, calls that don't
fit are rows with an error, and each tool gets all its valid calls as one frame with typed argument columns, so that a tool is
a DataFrame operation (a join with a table, a search, a column function) and not a call a row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions import tools as f
from corvine.operators.retrieval import top
from corvine.operators.texts import containing
from corvine.sources.folders import written
from corvine.sources.tables import spread

#: JSON's types and the columns they become.
TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


@dataclass(frozen=True)
class Tool:
    """A named table function.

    arguments: a type of TYPES for each argument; required: those that a call must give; choices: the values that an argument may have. run takes the
    valid calls (call_id and a column for each argument, null where it isn't given) and returns call_id, result (text, best JSON), error: a row for
    each result, none for a call without any. about: words of which a message has one where the tool is of use (none: always).
    """

    name: str
    description: str
    arguments: dict[str, str]
    run: Callable[[DataFrame], DataFrame]
    required: tuple[str, ...] = ()
    choices: dict[str, tuple[str, ...]] = field(default_factory=dict)
    about: tuple[str, ...] = ()
    safety: str = "safe"

    def __post_init__(self) -> None:
        if unknown := {*self.required, *self.choices} - set(self.arguments):
            raise ValueError(f"{self.name}: no such arguments: {sorted(unknown)}")
        if wrong := set(self.arguments.values()) - set(TYPES):
            raise ValueError(f"{self.name}: unknown types: {sorted(wrong)}")
        if self.safety not in ("safe", "sensitive", "dangerous"):
            raise ValueError(f"{self.name}: unknown safety {self.safety}")

    def definition(self) -> dict:
        """What a model is told of the tool."""
        properties = {name: {"type": kind} | ({"enum": list(self.choices[name])} if name in self.choices else {}) for name, kind in self.arguments.items()}
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": properties, "required": list(self.required)}}}

    def faults(self, given: Column) -> Column:
        """What is wrong with arguments (map from name to JSON value), or null: the first fault in the order missing, unknown, type, choice."""
        names = F.map_keys(given)
        missing = F.filter(F.array(*map(F.lit, self.required)), lambda n: F.coalesce(F.element_at(given, n), F.lit("null")) == "null") if self.required else F.array().cast("array<string>")
        unknown = F.array_sort(F.filter(names, lambda n: ~n.isin(list(self.arguments))) if self.arguments else names)
        shapes = {"string": r'(?s)^".*"$', "integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$", "boolean": "^(true|false)$"}
        value = lambda n: F.element_at(given, F.lit(n))
        stated = lambda n: F.coalesce(value(n), F.lit("null")) != "null"
        wrong = [F.when(stated(n) & ~value(n).rlike(shapes[kind]), f"{n} must be of type {kind}") for n, kind in self.arguments.items()]
        chosen = [F.when(stated(n) & ~value(n).isin([json.dumps(c, ensure_ascii=False) for c in allowed]), f"{n} must be one of {', '.join(allowed)}") for n, allowed in self.choices.items()]
        listed = lambda title, found: F.when(F.size(found) > 0, F.concat(F.lit(title), F.array_join(found, ", ")))
        return F.coalesce(listed("missing: ", missing), listed("unknown: ", unknown), *wrong, *chosen)


class Toolbox:
    """Tools by name."""

    def __init__(self, *tools: Tool) -> None:
        self.tools: dict[str, Tool] = {}
        for tool in tools:
            self.add(tool)

    def add(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"there is a tool {tool.name} already")
        self.tools[tool.name] = tool

    def definitions(self, *names: str) -> list[dict]:
        return [self.tools[n].definition() for n in (names or self.tools)]

    def checked(self, calls: DataFrame) -> DataFrame:
        """call_id, tool, arguments, error of each call; error is null where the tool may run."""
        # a JSON object's values as they are written; null: no object
        parsed = calls.select("call_id", "tool", "arguments", F.try_parse_json("arguments").alias("v"))
        shown = F.transform_values(F.try_variant_get("v", "$", "map<string,variant>"), lambda _, v: F.to_json(v))
        rows = parsed.select("call_id", "tool", "arguments", F.when(F.schema_of_variant("v").startswith("OBJECT"), shown).alias("given"))
        faults = F.coalesce(*[F.when(F.col("tool") == name, tool.faults(F.col("given"))) for name, tool in self.tools.items()]) if self.tools else F.lit(None).cast("string")
        known = F.coalesce(F.col("tool").isin(list(self.tools)), F.lit(False))
        error = F.when(~known, F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit("")))).when(F.col("given").isNull(), "arguments must be a JSON object").otherwise(faults)
        return rows.select("call_id", "tool", "arguments", error.alias("error"))

    def answered(self, calls: DataFrame) -> DataFrame:
        """call_id, tool, result, error: a row for each result of each call, one with an error for a call that is not valid or fails, one with neither for a call
        without a result. A repeated call_id is answered for each of its calls."""
        checked = written(self.checked(spread(calls)), "calls")  # each tool reads its own calls: they are checked once
        bad = checked.where("error IS NOT NULL").select("call_id", "tool", F.lit(None).cast("string").alias("result"), "error")
        found = [bad]
        for name, tool in self.tools.items():
            schema = ", ".join(f"`{a}` {TYPES[k]}" for a, k in tool.arguments.items())
            own = checked.where((F.col("tool") == name) & F.col("error").isNull())
            typed = own.select("call_id", F.from_json("arguments", schema).alias("a")).select("call_id", "a.*") if schema else own.select("call_id")
            results = tool.run(typed).select(F.col("call_id").alias("__id"), "result", "error")
            found.append(own.select("call_id", "tool").join(results, F.col("call_id") == F.col("__id"), "left").select("call_id", "tool", "result", "error"))
        return reduce(DataFrame.union, found)

    def offered(self, messages: DataFrame, text: str = "text") -> DataFrame:
        """messages with tools: the names of those that are of use for the message, so that only these are described to a model."""
        said = F.coalesce(F.col(text), F.lit(""))
        of_use = [F.when(reduce(Column.__or__, [F.contains(said, F.lit(w)) for w in tool.about]) if tool.about else F.lit(True), F.lit(name)) for name, tool in self.tools.items()]
        return messages.withColumn("tools", F.filter(F.array(*of_use), lambda x: x.isNotNull()))


def calculator() -> Tool:
    def run(calls: DataFrame) -> DataFrame:
        value = calls.select("call_id", "expression", f.calculated(F.col("expression")).alias("value"))
        return value.select("call_id", F.when(F.col("value").isNotNull(), F.to_json(F.struct("expression", F.col("value").alias("result")))).alias("result"), F.when(F.col("value").isNull(), "not an arithmetic expression").alias("error"))

    return Tool("calculator", "Calculates: + - * / // % **, powers, roots, logarithms, trigonometry.", {"expression": "string"}, run, ("expression",), about=("计算", "算", "等于", "求解", "加", "减", "乘", "除", "%"))


def dates(now: Column | None = None) -> Tool:
    """now: the time that counts as the present."""

    def run(calls: DataFrame) -> DataFrame:
        at = F.current_timestamp() if now is None else now
        parts = f.date_parts(at)
        present = F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))
        end = F.coalesce("date2", F.date_format(at, "yyyy-MM-dd"))
        days = f.days_between(F.col("date1"), end)
        between = F.to_json(F.struct("date1", end.alias("date2"), days.alias("diff_days")))
        diff = F.col("action") == "diff"
        error = F.when(diff & F.col("date1").isNull(), "missing: date1").when(diff & days.isNull(), "not a date")
        return calls.select("call_id", F.when(error.isNull(), F.when(diff, between).otherwise(present)).alias("result"), error.alias("error"))

    return Tool("datetime_info", "The present date and time, or the days between two dates.", {"action": "string", "date1": "string", "date2": "string"}, run, ("action",), {"action": ("now", "diff")}, ("几点", "几号", "日期", "时间", "星期", "今天", "明天", "昨天"))


def lookup(tables: dict[str, tuple[DataFrame, str]], most: int = 20) -> Tool:
    """Rows of named tables (frame, column to search), as JSON: those whose column contains the keyword in any case, all without one; the first `most` by that column."""

    def run(calls: DataFrame) -> DataFrame:
        found = []
        for name, (rows, column) in tables.items():
            asked = calls.where(F.col("table") == name).select("call_id", F.lower(F.coalesce("keyword", F.lit(""))).alias("__k"), F.least(F.coalesce("limit", F.lit(most)), F.lit(most)).alias("__most"))
            held = rows.select(F.col(column).cast("string").alias("__c"), F.lower(F.col(column).cast("string")).alias("__l"), F.to_json(F.struct("*")).alias("result"))
            met = containing(held, "__l", asked.where("trim(__k) <> ''"), "__k")
            first = held.orderBy("__c", "result").limit(most)  # what a call without a keyword gets
            every = asked.where("trim(__k) = ''").crossJoin(F.broadcast(first))
            columns = ["call_id", "__c", "result", "__most"]
            both = met.select(*columns).union(every.select(*columns))
            found.append(top(both, most, F.asc("__c"), F.asc("result"), by="call_id", rank="__r").where("__r <= __most").select("call_id", "result"))
        return reduce(DataFrame.union, found).withColumn("error", F.lit(None).cast("string"))

    return Tool("database_query", "Looks rows up in a table by a keyword.", {"table": "string", "keyword": "string", "limit": "integer"}, run, ("table",), {"table": tuple(tables)}, ("学院", "专业", "班级", "组织", "院系", "学校"))


def knowledge_search(search: Callable[[DataFrame, int], DataFrame], most: int = 5) -> Tool:
    """search takes questions (query_id, text) and how many results are wanted, and gives query_id, score, content (best first by score)."""

    def run(calls: DataFrame) -> DataFrame:
        found = search(calls.select(F.col("call_id").alias("query_id"), F.col("query").alias("text")), most)
        met = found.join(calls.select(F.col("call_id").alias("query_id"), F.least(F.coalesce("top_k", F.lit(most)), F.lit(most)).alias("__most")), "query_id")
        best = top(met, most, F.desc("score"), F.asc("content"), by="query_id", rank="__r").where("__r <= __most")
        return best.select(F.col("query_id").alias("call_id"), F.to_json(F.struct("score", "content")).alias("result"), F.lit(None).cast("string").alias("error"))

    return Tool("knowledge_search", "Searches the knowledge base.", {"query": "string", "top_k": "integer"}, run, ("query",))
