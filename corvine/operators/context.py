"""From ranked evidence to a prompt: packing under a token budget, citations, memory, corrective retrieval, grounding."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions.text import render, token_count


def pack(results: DataFrame, budget: int = 2000, label: str = "[来源{n}]", longest_name: int = 40) -> DataFrame:
    """query_id, label, source, block, n_tokens, place of the evidence that fits into the budget (500 to 8000 tokens).

    results: query_id, place, source, content. Blocks (a head with label and source, then the content) are taken in order; the one
    that doesn't fit is cut in proportion and is the last; when 40 tokens or fewer are left nothing more is taken. Blank
    contents don't count. Running sums over a query's few results.
    """
    budget = max(500, min(budget, 8000))
    order = Window.partitionBy("query_id").orderBy("place")
    rows = results.withColumn("content", F.trim(F.coalesce("content", F.lit("")))).where("content <> ''").withColumn("n", F.row_number().over(order))
    name = F.when(F.coalesce("source", F.lit("")) == "", F.lit("未知")).otherwise(F.col("source"))
    name = F.when(F.length(name) > longest_name, F.concat(F.substring(name, 1, longest_name - 3), F.lit("..."))).otherwise(name)
    rows = rows.withColumn("label", F.replace(F.lit(label), F.lit("{n}"), F.col("n").cast("string"))).withColumn("head", F.concat("label", F.lit("（"), name, F.lit("）")))
    whole = token_count(F.concat("head", F.lit("\n"), "content")) + 5
    before = F.coalesce(F.sum("__whole").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__whole", whole).withColumn("left", F.lit(budget) - before - token_count(F.col("head")) - 5)
    rows = rows.withColumn("fits", token_count(F.col("content")) <= F.col("left"))
    stopped = F.coalesce(F.max((~F.col("fits")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("__stopped", stopped).where((F.col("__stopped") == 0) & (F.col("left") > 40))
    cut = F.greatest(F.lit(40), F.floor(F.length("content") * F.col("left") / token_count(F.col("content")))).cast("int")
    content = F.when(F.col("fits"), F.col("content")).otherwise(F.rtrim(F.substring(F.col("content"), F.lit(1), cut)))
    block = F.concat("head", F.lit("\n"), content)
    return kept.select("query_id", "place", "label", "source", block.alias("block"), token_count(block).alias("n_tokens"))


def cited(answer: Column, label: str = "来源") -> Column:
    """The numbers that an answer cites ([来源3]), rising, each once."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(rf"\[{label}(\d{{1,9}})\]"), F.lit(1)), lambda x: x.cast("int"))))


def renumbered(answer: Column, label: str = "来源") -> Column:
    """The answer with its citations numbered from 1 in the order of their old numbers."""
    old = cited(answer, label)
    placed = F.aggregate(old, answer, lambda text, n: F.replace(text, F.concat(F.lit(f"[{label}"), n.cast("string"), F.lit("]")), F.concat(F.lit("\u0000"), F.array_position(old, n).cast("string"), F.lit("\u0001"))))
    return F.regexp_replace(placed, "\u0000(\\d+)\u0001", f"[{label}$1]")


def cite_order(sources: DataFrame, answers: DataFrame, label: str = "来源") -> DataFrame:
    """Sources (query_id, n, …) with new_n: cited ones first, in the order of their numbers, the others after them. Where nothing is
    cited, or 1 to m are, numbers stay."""
    met = sources.join(answers.select("query_id", cited(F.col("answer"), label).alias("__c")), "query_id", "left")
    used = F.coalesce(F.array_contains("__c", F.col("n")), F.lit(False))
    return met.withColumn("new_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(used), "n"))).drop("__c")


def memory(messages: DataFrame, budget: int = 3000, recent: int = 6, stub: str = "[历史摘要] 之前进行了 {n} 轮对话。") -> DataFrame:
    """conv_id, turn, role, text of what is kept of each conversation within a token budget.

    All if it fits; else the last `recent` messages after a stub (turn -1, role system) that counts the others; if those are
    too long as well, as many of the last ones as fit, two at least, without a stub.
    """
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.select("conv_id", "turn", "role", "text", token_count(F.col("text")).alias("__t"))
    rows = rows.withColumn("__n", F.row_number().over(last)).withColumn("__sum", F.sum("__t").over(last.rowsBetween(Window.unboundedPreceding, 0)))
    of = rows.groupBy(F.col("conv_id").alias("__c")).agg(F.sum("__t").alias("total"), F.count("*").alias("number"), F.sum(F.when(F.col("__n") <= recent, F.col("__t"))).alias("near"), F.sum(((F.col("__n") <= recent) & (F.col("__sum") <= budget)).cast("int")).alias("fit"))
    fits, tight = F.col("total") <= budget, F.col("near") >= budget
    keep = F.when(fits, F.col("number")).when(tight, F.when(F.col("fit") > 0, F.col("fit")).otherwise(2)).otherwise(F.least(F.lit(recent), F.col("number")))
    plan = of.withColumn("__keep", keep).withColumn("__stub", ~fits & ~tight & (F.col("number") > recent))
    kept = rows.join(plan, F.col("conv_id").eqNullSafe(F.col("__c"))).where(F.col("__n") <= F.col("__keep")).select("conv_id", "turn", "role", "text")
    stubs = plan.where("__stub").select(F.col("__c").alias("conv_id"), F.lit(-1).cast(dict(messages.dtypes)["turn"]).alias("turn"), F.lit("system").alias("role"), F.replace(F.lit(stub), F.lit("{n}"), (F.col("number") - recent).cast("string")).alias("text"))
    return kept.union(stubs)


# What stands above the template's and the refusal's part of a prompt.
PROMPT_HEAD, REFUSAL_HEAD = "【Prompt 模板】\n", "【禁止回答策略】\n"


def prompt(template: Column, context_template: Column, refusal: Column, blocks: Column, values: dict[str, Column]) -> Column:
    """The system messages (array of role, content) before a question: the rendered template unless it is blank, the rendered context template if
    there are blocks, and what to answer without grounds. Values are put in place of their names; context_blocks is the blocks."""
    named = values | {"context_blocks": blocks}
    head = F.trim(render(F.coalesce(template, F.lit("")), named))
    parts = [F.when(head != "", F.concat(F.lit(PROMPT_HEAD), head)), F.when(F.coalesce(blocks, F.lit("")) != "", render(context_template, named)), F.concat(F.lit(REFUSAL_HEAD), refusal)]
    return F.filter(F.array(*[F.struct(F.lit("system").alias("role"), p.alias("content")) for p in parts]), lambda m: m["content"].isNotNull())


def token_stats(messages: DataFrame, most: int = 3000, reserve: int = 500) -> DataFrame:
    """conv_id, total_tokens, usage_ratio (of `most`), message_count, needs_compression (more than `most` without the reserve) of each conversation."""
    counted = messages.groupBy("conv_id").agg(F.sum(token_count(F.col("text"))).alias("total_tokens"), F.count("*").alias("message_count"))
    return counted.select("conv_id", "total_tokens", F.round(F.col("total_tokens") / most, 2).alias("usage_ratio"), "message_count", (F.col("total_tokens") > most - reserve).alias("needs_compression"))


def corrective(first: DataFrame, second: DataFrame, least: float = 0.35, at_least: int = 1) -> DataFrame:
    """query_id, place, content, similarity, round: first results, and for queries that they don't satisfy the second ones after them.

    Both: query_id, content, similarity. A query is satisfied by `at_least` results of which the best has a similarity of `least` or
    more. A content counts once, as the first round has it; places go on from round to round. `second` may be computed for
    all queries: only those that ask for it are read from it (a semi join, which filters its input).
    """
    queries = first.select("query_id").union(second.select("query_id")).distinct()
    grades = first.groupBy("query_id").agg(((F.count("*") >= at_least) & (F.max("similarity") >= least)).alias("good"))
    again = queries.join(grades.where("good"), "query_id", "left_anti")
    rows = first.select("query_id", "content", "similarity", F.lit(1).alias("round")).union(second.join(again, "query_id", "left_semi").select("query_id", "content", "similarity", F.lit(2)))
    once = rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "content").orderBy("round", F.desc("similarity")))).where("__n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("round", F.desc("similarity"), "content"))
    return once.select("query_id", place.alias("place"), "content", "similarity", "round")


def grounding(claims: DataFrame, sources: DataFrame, judge=None) -> DataFrame:
    """answer_id, n_claims, n_supported, n_unknown, grounded_ratio of claims (answer_id, claim) against sources (answer_id, content).

    judge(claim, contents) is a column: supported, unsupported, contradicted or unknown; by default a claim is supported if a source
    contains it. unknown counts as supported, as do answers without a claim in sources (ratio 1).
    """
    judge = judge or (lambda claim, contents: F.when(F.exists(contents, lambda c: F.contains(F.lower(c), F.lower(claim))), "supported").otherwise("unsupported"))
    held = sources.groupBy("answer_id").agg(F.collect_list("content").alias("__s"))
    met = claims.join(held, "answer_id", "full").withColumn("__v", F.when(F.col("claim").isNotNull(), F.coalesce(judge(F.col("claim"), F.coalesce("__s", F.array().cast("array<string>"))), F.lit("unknown"))))
    agg = met.groupBy("answer_id").agg(F.count("claim").alias("n_claims"), F.count_if(F.col("__v").isin("supported", "unknown")).alias("n_supported"), F.count_if(F.col("__v") == "unknown").alias("n_unknown"))
    return agg.withColumn("grounded_ratio", F.round(F.when(F.col("n_claims") == 0, 1.0).otherwise(F.col("n_supported") / F.col("n_claims")), 4))
