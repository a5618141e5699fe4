"""Column functions over texts: cleaning, gates, tokens, extraction.

Lengths are in code points, white space is Unicode's. What is a formula is built from Spark's functions;
only the two cleaners, folds over a text's lines, are Arrow functions.
"""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines of crawled pages that are navigation.
NAVIGATION = """
首页 学校概况 学校简介 大学章程 历史沿革 学校文化 现任领导 历任领导 组织机构 人才培养 本科生教育 研究生教育
国际生教育 远程教育 学科建设 招生就业 本科生招生 研究生招生 成人招生 就业网 科学研究 科研工作 人文社科 技术转移
人才招聘 合作交流 校友之家 基金会 校友办 新闻网 教学单位 机构设置 导航 正文 信息公开 接诉即办
党政办公室 教务部 学团工作部 安全管理部 后勤管理部 图书馆 国际交流部 工会 科研部 财务部 资产部
学部概况 学部简介 学部信箱 学校主页 泰安校区 济南校区 青岛校区 通知公告 学部新闻 教育教学 教学动态 管理制度
实验教学 教学团队 党建工作 工会活动 下载专区 联系我们 English 智慧校园 师资队伍 新闻中心 新闻动态 科研成果
学生工作 团学活动 就业信息 招生信息 学院概况 学院简介 专业介绍 培养方案 课程建设 教学改革 实践教学 创新创业
学术交流 学术讲座 规章制度 办事指南 常用下载 友情链接 快速通道 服务指南 网站地图 在线服务 数字资源 馆藏查询
""".split()

# What marks a line as a page's footer (in lower case).
FOOTERS = ["icp备", "all rights reserved", "版权所有", "备案号", "鲁公网安备", "邮编", "copyright", "鲁icp"]

# Heads of metadata lines, and the mark of a downloaded attachment.
METADATA_LINE = r"(?m)^(标题|来源URL|发布日期|抓取时间|来源|发布时间)\s*[:：].*$"
ATTACHMENT = r"附件【[^】]*】已下载\s*\d*\s*次?"

# Words without a meaning of their own.
STOPWORDS = """
的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 被
从 把 对 与 为 之 其 而 及 以 或
the a an is are was were be been being have has had do does did will would could should may might can shall
of in to for on with at by from as into about but not or and if this that it he she they
""".split()

# Requests to set aside a system's instructions.
INJECTION = (
    r"(?i)(忽略.{0,10}(之前|上面|以上|所有).{0,10}(指令|规则|设定|提示|prompt))|(ignore.{0,15}(previous|above|all).{0,15}(instructions?|rules?|prompts?))"
    r"|(你现在是一个没有.{0,10}(限制|约束))|(do\s*not\s*follow.{0,15}(rules?|instructions?))|(system\s*prompt)|(你的(系统|初始)(提示|指令|设定)是什么)"
    r"|(repeat.{0,10}(system|initial).{0,10}(prompt|instruction))"
)

# Punctuation that counts as meaningful.
MEANINGFUL = "，。！？、；：\"（）"

#: Unicode white space; Java's \s and trim() know ASCII's only.
SPACE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}"
#: The same characters, one by one.
SPACES = "\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends. Trimmed, not replaced: a pattern looks at every place of the text, not at its ends only."""
    return F.trim(text, F.lit(SPACES))


def clean_web(text: Column, navigation: list[str] = NAVIGATION, footers: list[str] = FOOTERS) -> Column:
    """The body of a crawled page: without metadata lines, attachment marks, footers, navigation lines (and short lines
    after three of them), lines of two characters at most and repeated lines; one blank line at most in a row.
    Null and empty texts become empty."""
    known, marks = frozenset(navigation), tuple(footers)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _clean_web(t, known, marks), na_action=None)

    return cleaned(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), METADATA_LINE, ""), ATTACHMENT, ""))


def _clean_web(text: str, navigation: frozenset, footers: tuple) -> str:
    out: list[str] = []
    run = 0  # run: navigation lines in a row so far
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            run = 0
            if out and out[-1]:
                out.append("")
            continue
        if any(mark in line.lower() for mark in footers):
            continue
        if (line in navigation and len(line) <= 20) or (run >= 3 and len(line) <= 25):
            run += 1
            continue
        run = 0
        if len(line) > 2:
            out.append(line)
    return _once(out)


def _once(lines: list[str]) -> str:
    """Lines joined, each non-blank one at its first place only, with one blank line at most between two."""
    seen, kept = set(), []
    for line in lines:
        if line == "" or line not in seen:
            kept.append(line)
            seen.add(line)
    return re.sub("\n{3,}", "\n\n", "\n".join(kept).strip())


_PAGE_NUMBER = re.compile(r"[\s\-–—]*\d+[\s\-–—]*|第\s*\d+\s*页|Page\s+\d+\s*", re.IGNORECASE)


def clean_document(text: Column) -> Column:
    """The text of an office file: without page numbers, single signs, a short line (50 characters) that repeats the one
    before and other repeated lines; one blank line at most in a row. Null and empty texts become empty."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(_clean_document)

    return cleaned(F.coalesce(text, F.lit("")))


def _clean_document(text: str) -> str:
    out: list[str] = []
    before = ""
    for line in map(str.strip, text.split("\n")):
        if not line:
            if out and out[-1]:
                out.append("")
        elif not (_PAGE_NUMBER.fullmatch(line) or (len(line) == 1 and not line.isalnum()) or (line == before and len(line) <= 50)):
            before = line
            out.append(line)
    return _once(out)


def worth_indexing(text: Column, least: int = 20) -> Column:
    """Long enough, and most of it letters, digits or sentence signs. False for null."""
    size = F.length(strip(text))
    meaningful = F.length(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{MEANINGFUL}]+", ""))
    judged = lambda n: (n["size"] >= least) & (n["meaningful"] >= n["size"] * 0.6) & (n["meaningful"] >= least * 0.5)
    # of an array of one, so that each length is taken once for all that is asked of it
    return F.coalesce(F.exists(F.array(F.struct(size.alias("size"), meaningful.alias("meaningful"))), judged), F.lit(False))


def quality_chunk(text: Column, navigation: list[str] = NAVIGATION) -> Column:
    """Not a menu or a list of links: lines are long enough on average, few are short, few are navigation."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")

    def judged(lines: Column) -> Column:
        number = F.size(lines)
        total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
        short = F.size(F.filter(lines, lambda x: F.length(x) <= 10))
        hits = F.size(F.filter(lines, lambda x: x.isin(navigation)))
        menu = (hits >= 3) & (hits > 0.3 * number)
        return (number > 0) & ~menu & (total >= 15 * number) & (short <= 0.6 * number)

    # of an array of one, so that the lines are made once for all that is asked of them
    return F.coalesce(F.exists(F.array(lines), judged), F.lit(False))


def words(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-case words (letters, marks, digits, _), repeats included, without stopwords."""
    found = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+", " "), " ")
    # one pass over a hashed list: isin() of literals is a set lookup
    return F.filter(found, lambda w: (w != "") & ~w.isin(stopwords))


def with_synonyms(groups: list[list[str]], tokens=None):
    """A tokenizer that gives the first word of a group for each of its words; use it for texts and questions alike."""
    first = {w.lower(): group[0].lower() for group in groups for w in group[1:]}

    def run(text: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
        return F.transform((tokens or words)(text), lambda w: F.coalesce(known[w], w))

    return run


def bigrams(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Pairs of neighbouring characters of the lower-case text with blanks for signs; pairs with a blank lose it."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{M}}\p{{N}}_{SPACE}]", " ")
    places = F.when(F.length(plain) > 1, F.sequence(F.lit(1), F.length(plain) - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(places, lambda i: strip(F.substring(plain, i, F.lit(2))))
    return F.filter(pairs, lambda w: (w != "") & ~w.isin(stopwords))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The set of a text's n-grams; shorter texts have none."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


def jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of the texts' n-gram sets; where one has none, 1 for equal texts and 0 for others."""
    x, y = char_ngrams(a, n), char_ngrams(b, n)
    return F.when((F.length(a) < n) | (F.length(b) < n), (a == b).cast("double")).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def sentences(text: Column) -> Column:
    """A text's sentences, without white space at their ends."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？.!?\n])\s*"), strip), lambda s: s != "")


def markdown_source(text: Column) -> Column:
    """Without HTML comments and white space at the ends."""
    return strip(F.regexp_replace(text, r"(?s)<!--.*?-->", ""))


def html_text(html: Column) -> Column:
    """The visible text of a page: no scripts, styles, comments and tags; block elements end lines; the usual entities decoded."""
    hidden = "|".join(rf"<{tag}\b.*?</{tag}\s*>" for tag in ("script", "style", "head", "template", "noscript"))
    bare = F.regexp_replace(html, rf"(?is)<!--.*?-->|{hidden}", " ")
    lines = F.regexp_replace(bare, r"(?i)<(/?(p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|main|blockquote|pre)\b[^>]*|br\b[^>]*)>", "\n")
    text = F.regexp_replace(lines, r"(?s)<[^>]*>", " ")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):  # amp last: what it yields isn't decoded again
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x{0b}]+", " "), r" ?(\n ?)+", "\n"), F.lit("\n "))


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, host, sub-domain (first label of the host), path, and the first directory of a path."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return {"scheme": F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)), "host": host, "subdomain": F.substring_index(host, ".", 1), "path": path, "directory": F.regexp_extract(path, r"^/([^/]*)/", 1)}


def _date(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def publish_year(text: Column) -> Column:
    """The year of the first date (year, month, day) in the first 500 characters, or of the first year and month; null
    outside 1990 to 2030. A date outside that range isn't followed by another try."""
    head = F.substring(text, 1, 500)
    full, short = r"(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})", r"(\d{4})\s*年\s*\d{1,2}\s*月"
    year = F.when(head.rlike(full), _date(head, full, 1)).when(head.rlike(short), _date(head, short, 1))
    return F.when(year.cast("int").between(1990, 2030), year)


def publish_date(text: Column) -> Column:
    """The first date in the first 500 characters as yyyy-mm-dd; null without one, or outside 1990 to 2030."""
    head, full = F.substring(text, 1, 500), r"(\d{4})[-年/.](\d{1,2})[-月/.](\d{1,2})"
    parts = [_date(head, full, g) for g in (1, 2, 3)]
    found = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(head.rlike(full) & parts[0].try_cast("int").between(1990, 2030), found)


def asks_injection(message: Column) -> Column:
    """The message asks to set instructions aside."""
    return F.coalesce(message.rlike(INJECTION), F.lit(False))


def first_topic(message: Column, topics: Column) -> Column:
    """The first of the topics (array) that the message contains; null if none, or without topics."""
    return F.try_element_at(F.filter(topics, lambda t: F.contains(message, t)), F.lit(1))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Puts values in place of {{name}} and {name}; null becomes empty."""
    for name, value in values.items():
        filled = F.coalesce(value.cast("string"), F.lit(""))
        template = F.replace(F.replace(template, F.lit("{{" + name + "}}"), filled), F.lit("{" + name + "}"), filled)
    return template


def relevance_label(score: Column) -> Column:
    return F.when(score >= 0.75, "高").when(score >= 0.55, "中").when(score > 0, "低").otherwise("不足")


def token_count(text: Column) -> Column:
    """Half the length: the count used where no tokenizer is at hand."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 2).cast("long")


def cache_key(*parts: Column) -> Column:
    """First 20 hex digits of the SHA-256 of the parts as JSON."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256), 1, 20)


def content_match(found: Column, wanted: Column, stride: int = 30, upto: int = 100) -> Column:
    """Some piece of `stride` characters of the first `upto` of the wanted text is in the found one; line feeds and
    blanks don't count. A wanted text without other characters matches nothing."""
    a, b = F.regexp_replace(found, "[\n ]", ""), F.substring(F.regexp_replace(wanted, "[\n ]", ""), 1, upto)
    pieces = F.transform(F.sequence(F.lit(0), F.lit((upto - 1) // stride)), lambda i: F.substring(b, i * stride + 1, F.lit(stride)))
    return F.coalesce(F.exists(pieces, lambda p: (p != "") & F.contains(a, p)), F.lit(False))


def json_from(answer: Column, fields: list[str]) -> dict[str, Column]:
    """Whole numbers named in an answer: from a fenced JSON block, the outermost braces, or `name: digit` lines."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return {f: F.coalesce(*[F.get_json_object(F.when(j != "", j), f"$.{f}").try_cast("int") for j in (fenced, braces)], F.regexp_extract(answer, rf'(?i)"?{f}"?\s*[:：=]\s*(\d+)', 1).try_cast("int")).alias(f) for f in fields}


def enrollment_year(number: Column, latest: int) -> Column:
    """The first four characters of a student number, if they are a year from 2000 to latest."""
    year = F.when(F.substring(number, 1, 4).rlike(r"^\d{4}$"), F.substring(number, 1, 4).try_cast("int"))
    return F.when(year.between(2000, latest), year)


def highlights(question: Column, content: Column) -> Column:
    """The question's words that are in the content."""
    return F.filter(F.array_distinct(words(question)), lambda w: F.contains(F.lower(content), w))


def ending(path: Column) -> Column:
    """The file name's ending with its dot, in lower case; of a packed archive both (.tar.gz)."""
    return F.lower(F.regexp_extract(path, r"(?i)(\.tar\.[a-z0-9]+|\.[^./\\\\]+)$", 1))


def path_labels(path: Column, below: str = "output") -> dict[str, Column]:
    """department and category: the two folders under the first folder `below` of a path, if a file is in them."""
    found = [F.regexp_extract(path, rf"(?:^|/){below}/([^/]+)/([^/]+)(?:/|$)", g) for g in (1, 2)]
    return {"department": F.when(found[0] != "", found[0]), "category": F.when(found[1] != "", found[1])}


def citation(label: Column, source: Column, similarity: Column) -> Column:
    """A citation as a struct: label, source, score (0 to 1, four digits) and how relevant that is in a word."""
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(similarity, F.lit(0.0)))), 4)
    return F.struct(label.alias("label"), F.coalesce(source, F.lit("未知")).alias("source"), score.alias("score"), relevance_label(score).alias("relevance"))
