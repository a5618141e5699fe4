"""Constraints in questions: extraction by rules, translation to predicates and to a hint."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names by which departments are called, and their full names.
DEPARTMENTS = {
    "计算机": "计算机科学与工程学院", "计算机学院": "计算机科学与工程学院", "计科": "计算机科学与工程学院", "材料": "材料科学与工程学院", "材料学院": "材料科学与工程学院",
    "机电": "机械电子工程学院", "机电学院": "机械电子工程学院", "电气": "电气与自动化工程学院", "电气学院": "电气与自动化工程学院", "电子": "电子信息工程学院", "电信": "电子信息工程学院",
    "电信学院": "电子信息工程学院", "测绘": "测绘与空间信息学院", "测绘学院": "测绘与空间信息学院", "地科": "地球科学与工程学院", "地科学院": "地球科学与工程学院", "安环": "安全与环境工程学院",
    "安环学院": "安全与环境工程学院", "化生": "化学与生物工程学院", "化生学院": "化学与生物工程学院", "交通": "交通学院", "交通学院": "交通学院", "海洋": "海洋科学与工程学院",
    "海洋学院": "海洋科学与工程学院", "经管": "经济管理学院", "经管学院": "经济管理学院", "财经": "财经学院", "财经学院": "财经学院", "数学": "数学与系统科学学院", "数学学院": "数学与系统科学学院",
    "文法": "文法学院", "文法学院": "文法学院", "外语": "外国语学院", "外语学院": "外国语学院", "艺术": "艺术学院", "艺术学院": "艺术学院", "马院": "马克思主义学院", "马克思": "马克思主义学院",
    "储能": "储能技术学院", "储能学院": "储能技术学院", "智能装备": "智能装备学院", "智装": "智能装备学院", "创新创业": "创新创业学院", "土木": "土木工程与建筑学院", "土建": "土木工程与建筑学院",
    "教务处": "教务处", "教务": "教务处", "研究生院": "研究生院", "学生处": "学生工作处", "学工处": "学生工作处", "图书馆": "图书馆", "经济管理学院": "经济管理学院", "能源": "能源与矿业工程学院",
    "能源学院": "能源与矿业工程学院", "资源": "资源学院", "资源学院": "资源学院", "体育": "体育学院", "体育学院": "体育学院",
}


# The short names under which a department's news are filed, and what stands before them.
NEWS = "新闻网-"
NEWS_NAMES = {
    "计算机科学与工程学院": "计算机学院", "材料科学与工程学院": "材料学院", "机械电子工程学院": "机电学院", "电气与自动化工程学院": "自动化学院", "电子信息工程学院": "电信学院",
    "测绘与空间信息学院": "测绘学院", "地球科学与工程学院": "地科学院", "安全与环境工程学院": "安全学院", "化学与生物工程学院": "化工学院", "海洋科学与工程学院": "海洋学院",
    "经济管理学院": "经管学院", "土木工程与建筑学院": "土建学院", "储能技术学院": "储能学院", "能源与矿业工程学院": "能源学院", "数学与系统科学学院": "数学学院", "马克思主义学院": "马克思主义学院",
    "智能装备学院": "智能装备学院", "财经学院": "财经学院", "交通学院": "交通学院", "外国语学院": "外国语学院", "文法学院": "文法学院", "艺术学院": "艺术学院", "资源学院": "资源学院", "体育学院": "体育学院",
}


# The sub-domains of departments' sites.
SUBDOMAINS = {
    "jwc": "教务处", "yjsy": "研究生院", "xgc": "学生工作处", "rsc": "人事处", "kjc": "科技处", "cxcy": "创新创业学院", "gjjl": "国际交流合作处", "tsg": "图书馆", "zs": "招生网", "wenfa": "文法学院", "waiyu": "外国语学院",
    "art": "艺术学院", "mks": "马克思主义学院", "math": "数学与系统科学学院", "cem": "材料科学与工程学院", "jdxy": "机械电子工程学院", "dqxy": "电气与自动化工程学院", "dzxy": "电子信息工程学院", "cse": "计算机科学与工程学院",
    "cgse": "测绘与空间信息学院", "dqkx": "地球科学与工程学院", "aqxy": "安全与环境工程学院", "tmgc": "土木工程与建筑学院", "jt": "交通学院", "hysw": "海洋科学与工程学院", "hxsw": "化学与生物工程学院", "jjgl": "经济管理学院",
    "cjxy": "财经学院", "cnxy": "储能技术学院", "ta": "智能装备学院", "znzb": "智能装备学院", "news": "新闻网", "www": "学校官网",
}


def department_of_site(url: Column, domain: str, names: dict[str, str] = SUBDOMAINS) -> Column:
    """The department on whose site of a domain a page lies: http(s)://sub-domain.domain; a sub-domain without a name stands for itself. Empty for other sites, null for null."""
    label = F.regexp_extract(url, rf"^https?://(\w+)\.{domain.replace('.', chr(92) + '.')}", 1)
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(known[label], label)


def year_in(question: Column) -> Column:
    """The first four digits before 年, if from 1990 to 2030."""
    year = F.regexp_extract(question, r"(\d{4})\s*年", 1)
    return F.when(year.try_cast("int").between(1990, 2030), year)


def named_in(question: Column, names: dict[str, str] = DEPARTMENTS) -> Column:
    """The full name of the longest name that the question contains; of equally long ones the first of the list."""
    order = sorted(names, key=lambda n: -len(n))
    return F.coalesce(*[F.when(F.contains(question, F.lit(n)), F.lit(names[n])) for n in order])


def variants(name: Column, short: dict[str, str] = NEWS_NAMES, lead: str = NEWS) -> Column:
    """The names under which a department's rows may be filed: its own, and its short and own name with the lead, each once; null for null."""
    known = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])[name]
    return F.when(name.isNotNull(), F.array_distinct(F.array_compact(F.array(name, F.concat(F.lit(lead), known), F.concat(F.lit(lead), name)))))


def hint(labelled: dict[str, Column]) -> Column:
    """label=value of the values that are given, joined by 、."""
    return F.concat_ws("、", *[F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), c.cast("string"))) for n, c in labelled.items()])


def predicate(where: dict) -> Column:
    """A metadata filter as a predicate: {"a": 1}, {"a": {"$in": [1, 2]}}, $eq, $ne, $gt, $gte, $lt, $lte, and {"$and": [...]}, {"$or": [...]}."""
    tests = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)), "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}
    found = []
    for name, value in where.items():
        if name == "$and":
            found.append(reduce(Column.__and__, map(predicate, value), F.lit(True)))
        elif name == "$or":
            found.append(reduce(Column.__or__, map(predicate, value), F.lit(False)))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        elif isinstance(value, dict):
            found += [tests[op](F.col(name), v) for op, v in value.items()]
        else:
            found.append(F.col(name).isNull() if value is None else F.col(name) == value)
    return reduce(Column.__and__, found, F.lit(True))


def constrained(year: Column | None = None, department: Column | None = None, since: Column | None = None, until: Column | None = None, category: Column | None = None) -> Column:
    """The rows (publish_year, department, publish_date, category) that meet a question's constraints, a department under any of its
    variants; a null constraint holds for all."""
    tests = [(year, lambda v: F.col("publish_year") == v), (department, lambda v: F.array_contains(variants(v), F.col("department"))), (category, lambda v: F.col("category") == v), (since, lambda v: F.col("publish_date") >= v), (until, lambda v: F.col("publish_date") <= v)]
    return reduce(Column.__and__, [v.isNull() | F.coalesce(test(v), F.lit(False)) for v, test in tests if v is not None], F.lit(True))
