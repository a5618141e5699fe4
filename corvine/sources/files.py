"""Files as texts: office files, Markdown, HTML, plain text in several encodings, and archives of them.

Files are read by Spark (binaryFile) from any store; a task parses one file at a time with the standard library.
"""

import io
import re
import tarfile
import unicodedata
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.sources.folders import written

#: Tried in this order when a text is not UTF-8.
ENCODINGS = ["utf-8-sig", "gb18030", "big5", "shift_jis", "euc_kr", "cp1252", "latin-1"]
# Limits for archives, bytes of a member, of all, and how many times larger than packed a member may be.
MEMBER_BYTES, ARCHIVE_BYTES, RATIO = 500 << 20, 1 << 30, 100
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")
TEXTS = (".txt", ".md", ".markdown", ".csv", ".json", ".html", ".htm")
OFFICE = (".docx", ".xlsx", ".pptx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def is_binary(content: Column) -> Column:
    """A zero byte among the first hundred."""
    return F.hex(F.substring(content, 1, 100)).rlike("^(..)*?00")


def _utf16(content: bytes) -> str | None:
    """The spelling of UTF-16 that a text has: by its byte order mark, or because every other byte of ASCII signs is zero."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    head = content[: len(content[:2000]) // 2 * 2]
    even, odd = head[::2].count(0), head[1::2].count(0)
    if head and max(even, odd) > 0.3 * len(head) / 2 and min(even, odd) < 0.05 * len(head) / 2:
        return "utf-16-le" if odd > even else "utf-16-be"
    return None


def decoded(content: bytes) -> str:
    """The text in the first encoding that fits (UTF-16 where its signs show); broken UTF-8 with replacements if none does."""
    if (wide := _utf16(content)) is not None:
        try:
            return content.decode(wide)
        except UnicodeDecodeError:
            pass
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    for name in ENCODINGS[1:]:
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        if not any(unicodedata.category(c) == "Cc" and c not in "\t\n\r\f\v" for c in text[:1000]):
            return text
    return content.decode("utf-8", "replace")


def table_markdown(rows: list[list[str]]) -> str:
    """Rows of cells as a Markdown table: single blanks, no empty rows, all of one width, the first one as its head."""
    cells = [[" ".join((c or "").split()).replace("|", "\\|") for c in row] for row in rows]
    cells = [row for row in cells if any(row)]
    if not cells:
        return ""
    width = max(map(len, cells))
    lines = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in cells]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _run_text(node: ET.Element) -> str:
    return "".join(x.text or "" if x.tag == _W + "t" else "\t" if x.tag == _W + "tab" else "\n" if x.tag == _W + "br" else "" for x in node.iter())


def docx_text(content: bytes) -> str:
    """Paragraphs and tables in the order of the body."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ET.fromstring(archive.read("word/document.xml")).find(_W + "body")
    out = []
    for node in body if body is not None else ():
        if node.tag == _W + "p":
            out.append(_run_text(node).strip())
        elif node.tag == _W + "tbl":
            out.append(table_markdown([[_run_text(c) for c in row.findall(_W + "tc")] for row in node.findall(_W + "tr")]))
    return "\n".join(filter(None, out))


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def xlsx_text(content: bytes) -> str:
    """Each sheet's name and its rows, cells joined by bars; empty rows left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        shared = [("".join(t.text or "" for t in si.iter(_S + "t"))) for si in ET.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(archive.read("xl/workbook.xml")).iter(_S + "sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            rows = []
            for row in ET.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}")).iter(_S + "row"):
                cells: dict[int, str] = {}
                for place, cell in enumerate(row.findall(_S + "c")):
                    value = cell.find(_S + "v")
                    text = "".join(t.text or "" for t in cell.iter(_S + "t")) if cell.get("t") == "inlineStr" else "" if value is None else value.text or ""
                    cells[_column(cell.get("r")) if cell.get("r") else place] = shared[int(text)] if cell.get("t") == "s" and text else text
                if any(v.strip() for v in cells.values()):
                    rows.append(" | ".join(cells.get(i, "").strip() for i in range(max(cells) + 1)))
            if rows:
                out.append("\n".join([f"【{sheet.get('name')}】", *rows]))
    return "\n\n".join(out)


def pptx_text(content: bytes) -> str:
    """Each slide's number, its paragraphs and its notes."""
    def paragraphs(data: bytes) -> list[str]:
        return [t for p in ET.fromstring(data).iter(_A + "p") if (t := "".join(x.text or "" for x in p.iter(_A + "t")).strip())]

    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        slides = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for place, (number, name) in enumerate(slides, 1):
            lines = paragraphs(archive.read(name))
            links = f"ppt/slides/_rels/slide{number}.xml.rels"
            notes = [r.get("Target") for r in ET.fromstring(archive.read(links)) if (r.get("Type") or "").endswith("/notesSlide")] if links in names else []
            for target in notes:
                path = "ppt/" + target.removeprefix("../").removeprefix("/ppt/")
                if path in names and (said := [t for t in paragraphs(archive.read(path)) if not t.isdigit()]):
                    lines.append("[备注] " + " ".join(said))
            if lines:
                out.append("\n".join([f"【第{place}页】", *lines]))
    return "\n\n".join(out)


PARSERS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".xlsx": xlsx_text, ".pptx": pptx_text}


def parsed(path: str, content: bytes, hooks: dict[str, Callable[[bytes], str | None]] | None = None) -> tuple[str | None, str | None]:
    """Text and error of one file by its name's ending. hooks: parsers of further endings (PDF, images), which need a model or a
    library that is not part of this one; without one such a file has no text."""
    ending = "." + path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    parser = (hooks or {}).get(ending) or PARSERS.get(ending)
    try:
        if parser is not None:
            return parser(content), None
        if b"\0" in content[:100] and _utf16(content) is None:
            return None, f"no parser for {ending or 'binary files'}"
        text = decoded(content)
        return (re.sub(r"(?s)<!--.*?-->", "", text).strip() if ending in (".md", ".markdown") else text), None
    except Exception as error:  # a broken file is a row with its error, not the end of a job
        return None, f"{type(error).__name__}: {error}"[:500]


def texts(files: DataFrame, hooks: dict[str, Callable[[bytes], str | None]] | None = None) -> DataFrame:
    """path, text, error of each file (path, content). Broken and unknown files have no text and an error; empty ones an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parsed(p, c or b"", hooks) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "text": [f[0] for f in found], "error": [f[1] for f in found]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content of all files under a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def _members(name: str, content: bytes) -> Iterator[tuple[str, int, int, Callable[[], bytes]]]:
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    shown = info.filename
                    if not info.flag_bits & 0x800:  # not marked as UTF-8: what zip reads as code page 437 is often a local one
                        try:
                            raw = shown.encode("cp437")
                            shown = next((t for e in ("utf-8", "gb18030") if (t := _try(raw, e)) is not None), shown)
                        except UnicodeEncodeError:
                            pass
                    yield shown, info.file_size, info.compress_size, lambda i=info: archive.read(i)
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as archive:
            for info in archive:
                if info.isfile():  # a tar file is packed as a whole
                    yield info.name, info.size, len(content), lambda i=info: archive.extractfile(i).read()


def _try(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def expanded(files: DataFrame, endings: tuple[str, ...] = TEXTS + OFFICE) -> DataFrame:
    """path (archive!member), content of the members of archives (zip, tar, tar.gz, tar.bz2, tar.xz) and, as they are, of other files.

    Left out: members that lead outside (.., absolute), of other endings, larger than MEMBER_BYTES or RATIO times their packed
    size, and what goes beyond ARCHIVE_BYTES or RATIO times the archive in all; an archive that can't be read has no members.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if not path.lower().endswith(ARCHIVES):
                    yield pd.DataFrame({"path": [path], "content": [content]})
                    continue
                total = 0
                try:
                    for name, size, packed, read in _members(path, content):
                        parts = name.replace("\\", "/").split("/")
                        if ".." in parts or name.startswith(("/", "\\")) or not name.lower().endswith(endings) or size > MEMBER_BYTES or size > RATIO * max(packed, 1) or total + size > min(ARCHIVE_BYTES, RATIO * len(content)):
                            continue
                        total += size
                        yield pd.DataFrame({"path": [f"{path}!{name}"], "content": [read()]})
                except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError):
                    continue

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


def folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """node, parent, depth, is_folder of the tree that paths (a/b/c) make: each prefix of a path once."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("__p")), lambda n: F.struct(F.array_join(F.slice("__p", 1, n), "/").alias("node"), F.array_join(F.slice("__p", 1, n - 1), "/").alias("parent"), n.alias("depth"), (n < F.size("__p")).alias("is_folder")))
    rows = paths.select(parts.alias("__p")).where(F.size("__p") > 0).select(F.explode(prefixes).alias("x")).select("x.*")
    return rows.groupBy("node", "parent", "depth").agg(F.max("is_folder").alias("is_folder"))


#: A parser of a cascade: path and content; gives a text, or nothing, or raises.
Stage = tuple[str, Callable[[str, bytes], str | None]]


def cascade(files: DataFrame, stages: list[Stage], least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Parsers in turn: (path, text, stage, n_attempts, error of each file; path, attempt, stage, n_chars, error of each attempt).

    A file whose text has at least `least` characters is done; only the others, with their content, go on to the next stage, so that the costly last ones (recognition
    of images) meet few. The last stage's text counts whatever its length. A file that no stage does keeps the last shorter text that there was, without
    a stage; one without any has the last error. A stage's attempts are written before the next begins, so none is made twice.
    """
    spark, left, made = files.sparkSession, files.select("path", "content"), []
    for number, (name, parser) in enumerate(stages):
        final = number == len(stages) - 1

        @F.udf("struct<text:string,error:string>", useArrow=True)
        def run(path: str, content: bytes, parser: Callable[[str, bytes], str | None] = parser) -> tuple[str | None, str | None]:
            try:
                return (parser(path, bytes(content or b"")) or "").strip() or None, None
            except Exception as error:  # a broken file is a row with its error, not the end of a job
                return None, f"{type(error).__name__}: {error}"[:500]

        tried = left.select("path", "content", run.asNondeterministic()("path", "content").alias("t"))
        done = F.coalesce(F.length("t.text") >= (1 if final else least), F.lit(False))
        made.append(written(tried.select("path", F.when(~done, F.col("content")).alias("content"), F.lit(number + 1).alias("attempt"), F.lit(name).alias("stage"), "t.text", "t.error", done.alias("done")), "cascade"))
        left = made[-1].where("NOT done").select("path", "content")
    attempts = reduce(DataFrame.union, [m.drop("content") for m in made])
    whole = attempts.groupBy("path").agg(
        F.max_by(F.struct("text", "stage", "done"), F.when(F.col("text").isNotNull(), F.col("attempt") + F.when(F.col("done"), 1000).otherwise(0))).alias("b"),
        F.max("attempt").cast("int").alias("n_attempts"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("attempt"))).alias("e"),
    )
    found = whole.select("path", "b.text", F.when(F.col("b.done"), F.col("b.stage")).alias("stage"), "n_attempts", F.when(F.col("b.text").isNull(), F.coalesce("e", F.lit("no text"))).alias("error"))
    return found, attempts.select("path", "attempt", "stage", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), "error")
