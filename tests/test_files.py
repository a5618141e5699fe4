import io
import tarfile
import zipfile

from corvine.sources import files, logs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members.items():
            archive.writestr(name, content)
    return out.getvalue()


def paragraph(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


DOCX = packed({"word/document.xml": f"<w:document {W}><w:body>{paragraph('first')}<w:tbl><w:tr><w:tc>{paragraph('a')}</w:tc><w:tc>{paragraph('b')}</w:tc></w:tr><w:tr><w:tc>{paragraph('1')}</w:tc></w:tr></w:tbl>{paragraph('last')}</w:body></w:document>"})
XLSX = packed({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>so</t></r><r><t>me</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3"><v>5</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": f'<worksheet {S}><sheetData><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
})
PPTX = packed({
    "ppt/slides/slide1.xml": f"<s {A}><a:p><a:r><a:t>Hello</a:t></a:r></a:p></s>", "ppt/slides/slide10.xml": f"<s {A}><a:p><a:r><a:t>Ten</a:t></a:r></a:p></s>", "ppt/slides/slide2.xml": f"<s {A}><a:p><a:r><a:t>Two</a:t></a:r></a:p></s>",
    "ppt/slides/_rels/slide2.xml.rels": '<Relationships><Relationship Id="r" Type="http://x/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>', "ppt/notesSlides/notesSlide1.xml": f"<s {A}><a:p><a:r><a:t>said</a:t></a:r></a:p></s>",
})


def test_parsers(spark):
    given = {"a.docx": DOCX, "b.xlsx": XLSX, "c.PPTX": PPTX, "d.md": "a <!-- x\n --> b".encode(), "e.txt": "中文文本".encode("gb18030"), "f.txt": b"\xef\xbb\xbfbom", "g.pdf": b"%PDF\0", "h.docx": b"broken", "i.txt": b"", "j": b"plain", "k.txt": "wide 文".encode("utf-16"), "l.txt": "plain wide text".encode("utf-16-le"), "m.txt": "plain wide text".encode("utf-16-be")}
    found = {r.path: (r.text, r.error) for r in files.texts(spark.createDataFrame([(k, bytearray(v)) for k, v in given.items()], "path string, content binary")).collect()}
    assert found["a.docx"][0] == "first\n| a | b |\n| --- | --- |\n| 1 |  |\nlast"
    assert found["b.xlsx"][0] == "【One】\nname |  | some\n5\n\n【Two】\nin"
    assert found["c.PPTX"][0] == "【第1页】\nHello\n\n【第2页】\nTwo\n[备注] said\n\n【第3页】\nTen"
    assert found["d.md"][0] == "a  b" and found["e.txt"][0] == "中文文本" and found["f.txt"][0] == "bom" and found["i.txt"][0] == "" and found["j"][0] == "plain"
    assert found["k.txt"][0] == "wide 文" and found["l.txt"][0] == found["m.txt"][0] == "plain wide text"
    assert found["g.pdf"][0] is None and "no parser" in found["g.pdf"][1] and found["h.docx"][0] is None and "BadZipFile" in found["h.docx"][1]


def test_expanded(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as archive:
        for name in ("x/y.txt", "../out.txt", "z.exe"):
            info = tarfile.TarInfo(name)
            info.size = 2
            archive.addfile(info, io.BytesIO(b"hi"))
    bomb = io.BytesIO()
    with tarfile.open(fileobj=bomb, mode="w:gz") as archive:
        for n in range(3):
            info = tarfile.TarInfo(f"{n}.txt")
            info.size = 1_000_000 if n else 2
            archive.addfile(info, io.BytesIO(b"0" * info.size))
    zipped = packed({"ok.txt": "yes", "../up.txt": "no", "bomb.txt": "0" * 1000000, "日本.md": "u"})
    rows = [("a.zip", zipped), ("b.tar.gz", tar.getvalue()), ("c.txt", b"as is"), ("d.zip", b"broken"), ("e.tgz", bomb.getvalue())]
    found = {r.path: bytes(r.content) for r in files.expanded(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert found == {"a.zip!ok.txt": b"yes", "a.zip!日本.md": b"u", "b.tar.gz!x/y.txt": b"hi", "c.txt": b"as is", "e.tgz!0.txt": b"00"}


def test_read_files_and_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("x")
    (tmp_path / "y.md").write_text("y")
    assert files.texts(files.read_files(spark, str(tmp_path))).count() == 2
    tree = {tuple(r) for r in files.folders(spark.createDataFrame([("a/b/c",), ("a/d",), ("",), (None,)], "path string")).collect()}
    assert tree == {("a", "", 1, True), ("a/b", "a", 2, True), ("a/b/c", "a/b", 3, False), ("a/d", "a", 2, False)}
    binary = spark.createDataFrame([(bytearray(b"a\0b"),), (bytearray(b"ab"),), (bytearray(b"\x10\x01"),)], "content binary").select(files.is_binary("content")).collect()
    assert [r[0] for r in binary] == [True, False, False]


def test_logs(spark, tmp_path):
    folder = tmp_path / "log"
    for day, lines in (("2024-01-01", '{"t": "2024-01-01T10:00:00", "v": 1}'), ("2024-01-09", '{"t": "2024-01-09T10:00:00", "v": 2, "more": 3}\nbroken\n{"t": "2024-01-03T09:00:00", "v": 4}\n{"t": "2024-01-02T09:00:00", "v": 5}')):
        (folder / f"date={day}").mkdir(parents=True)
        (folder / f"date={day}" / "x.json").write_text(lines)
    assert [r.v for r in logs.history(spark, str(folder), "t timestamp, v int", "t", 7).where("v IS NOT NULL").orderBy("v").collect()] == [2, 4]
    (tmp_path / "set.json").write_text('{"version": "1",\n "vector_db_id": 3, "items": [{"id": 1, "query": "q", "relevant_document_ids": ["a"]}, {"id": 2}]}')
    assert [(r.vector_db_id, r.id, r.relevant_document_ids) for r in logs.evaluation_items(spark, str(tmp_path / "set.json")).orderBy("id").collect()] == [(3, 1, ["a"]), (3, 2, None)]
    rows = spark.createDataFrame([("a", "x", {"k": "1"}, 0), ("b", "y", None, 0), ("c", "z", {}, 1)], "id string, document string, metadata map<string,string>, part int")
    logs.write_backup(rows, str(tmp_path / "backup"), "part")
    assert sorted((r.id, r.document) for r in logs.backup_rows(spark, str(tmp_path / "backup")).collect()) == [("a", "x"), ("b", "y"), ("c", "z")]
    logs.write_report(rows.select("id"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3
