"""Folders, spreadsheets, conversion and streams on files written here; the registered queries."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.engine import Engine
from marginalia.plans import catalogue
from marginalia.sources import files, tabular
from marginalia.streaming.ingest import new_files, windowed


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    for path, text in {
        "index.md": "---\nformat_version: 1\n---\n- [a](a.md)\n", "a.md": "---\ntype: Policy\ntags: [Safety, 7]\nstatus: stable\nupdated: 2026-01-01\n---\n# Alpha rules\n\nAll boxes are checked at the gate.\n",
        "sub/b.md": "---\ntitle: Bé\nsummary: short\ncategories: x, y\n---\nSee [a](../a.md).\n", "sub/c.md": "no metadata", ".hidden/x.md": "x", "node_modules/y.md": "y", "AGENTS.md": "z", "skip/z.md": "z", ".gitignore": "skip/\n# note\n", "t.csv": "a\n1\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "bad.md").write_bytes(b"\xff\xfe bad")
    return str(root)


def test_walk(folder):
    assert files.discover(folder) == ["a.md", "bad.md", "index.md", "sub/b.md", "sub/c.md"]
    assert files.walk(folder, ("csv",)) == ["t.csv"]


def test_documents(spark, folder):
    got = {r["id"]: r for r in files.documents(files.read_markdown(spark, folder)).collect()}
    assert sorted(got) == ["a", "bad", "index", "sub/b", "sub/c"]
    assert (got["a"]["title"], got["a"]["title_from"], got["a"]["tags"], got["a"]["updated"]) == ("Alpha rules", "heading", ["Safety", "7"], "2026-01-01")
    assert (got["sub/b"]["title"], got["sub/b"]["description"], got["sub/b"]["tags"]) == ("Bé", "short", ["x", "y"])
    assert got["sub/c"]["fm_state"] == "absent" and got["index"]["reserved"] and got["bad"]["error"] and got["bad"]["body"] is None
    shares = {r["top"]: (r["docs"], r["conformant"]) for r in files.folder_shares(files.read_markdown(spark, folder)).collect()}
    assert shares == {".": (3, 1), "sub": (2, 0)}


def test_engine_on_a_folder(spark, folder):
    e = Engine.open_folder(spark, folder)
    assert e.call("query", {"status": "stable"})["docs"][0]["id"] == "a"
    assert e.call("links", {"id": "a"})["backlinks"][0]["src"] in ("index", "sub/b")
    assert e.call("grep", {"pattern": "boxes"})["total_docs"] == 1
    assert e.call("search", {"query": "boxes at the gate"})["hits"][0]["id"] == "a"
    assert e.call("retrieve", {"query": "boxes"})["tokens"] > 0
    assert e.call("lint")["errors"] > 0 and e.call("vocabulary")
    with pytest.raises(ValueError, match="no tool"):
        e.call("drop")


def once_embedder(folder):
    class OnceEmbedder:
        """Fails where a text is embedded for the second time."""

        def __init__(self, folder):
            self.folder, self.model, self.dims = folder, "once", 16

        def documents(self, texts):
            import hashlib
            import os

            for t in texts:
                os.close(os.open(f"{self.folder}/{hashlib.md5(t.encode()).hexdigest()}", os.O_CREAT | os.O_EXCL))
            return self.queries(texts)

        def queries(self, texts):
            from marginalia.operators.vectors import LetterEmbedder

            return LetterEmbedder(self.dims).documents(texts)

    return OnceEmbedder(folder)


def test_nothing_is_embedded_twice(spark, tmp_path):
    from marginalia.operators.sync import State

    root, seen = tmp_path / "kb", tmp_path / "seen"
    seen.mkdir()
    (root / "_meta" / "types").mkdir(parents=True)
    for name, text in {"a.md": "# Boats\n\nBoats cross the wide river at dawn.", "b.md": "# Hills\n\nHills are green in spring.", "t.csv": "k,v\n1,x\n"}.items():
        (root / name).write_text(text)
    open_ = lambda: Engine.open_folder(spark, str(root), state=State(spark, str(tmp_path / "state")), embedder=once_embedder(str(seen)))
    e = open_()
    assert e.search("river boats")["hits"][0]["id"] == "a" and len(list(seen.iterdir())) == 2
    assert e.search("green hills")["hits"][0]["id"] == "b" and e.embed() == 0
    assert open_().search("green hills")["hits"][0]["id"] == "b"  # another process
    (root / "c.md").write_text("# Goats\n\nGoats climb the steep rock.")
    (root / "t.csv").write_text("k,v\n1,x\n2,y\n")
    e._ttl = 0
    assert e.call("search", {"query": "goats climb"})["hits"][0]["id"] == "c" and len(list(seen.iterdir())) == 3
    assert e.call("data_query", {"sql": "SELECT count(*) FROM t", "timeout": 60})["rows"] == [[2]]
    (root / "t.csv").unlink()
    assert e.call("data_tables") == []


def test_rules_see_the_whole_collection(spark, tmp_path):
    for name, text in {
        "_meta/vocabulary.md": "---\nterms:\n  boats: {synonyms: [ships], facet: topic}\n---\n", "_meta/types/Guide.md": "---\nfields:\n  owner: {type: string, required: true}\n  area: {type: list, enum: [N, S]}\n  size: {type: integer, enum: [1, 2]}\n---\n",
        "_meta/types/Odd.md": "---\nfields: 3\n---\n", "index.md": "---\nformat_version: 1\n---\n- [a](a.md)\n", "log.md": "## someday\n", "bad.md": None,
        "a.md": "---\ntype: Guide\ntitle: A\ndescription: All about the boats of the river\ntags: [Ships, odd]\nlang: en\nstatus: stable\nupdated: 2026-01-01\nsupersedes: [b, gone]\narea: [N, X]\nsize: 3\ngenerated: {by: x, fields: [title]}\n---\nSee [x](nowhere.md).\n",
        "b.md": "---\ntype: 7\ntitle: B\ndescription: An older text on the boats\ntags: [boats]\nlang: en\nstatus: stable\nupdated: 2026-01-01\nsupersedes: {a: 1}\n---\n", "s/c.md": "---\ntype: Guide\nowner: Kim\nsize: big\n---\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff") if text is None else (tmp_path / name).write_text(text)
    got = Engine.open_folder(spark, str(tmp_path)).lint(target=3)
    found = {(d["rule"], d["path"]) for d in got["diagnostics"]}
    for want in [
        ("unreadable", "bad.md"), ("invalid-type", "b.md"), ("invalid-schema", "_meta/types/Odd.md"), ("log-date-heading", "log.md"), ("stale-index", "index.md"), ("missing-index", "s/index.md"), ("unknown-tag", "a.md"),
        ("non-canonical-tag", "a.md"), ("unknown-supersedes", "a.md"), ("superseded-still-stable", "a.md"), ("invalid-supersedes", "b.md"), ("unreviewed-generated", "a.md"), ("schema-missing-field", "a.md"),
        ("schema-not-allowed", "a.md"), ("schema-wrong-type", "s/c.md"), ("broken-link", "a.md"), ("missing-title", "s/c.md"),
    ]:
        assert want in found, want
    assert ("no-vocabulary", "_meta/vocabulary.md") not in found and ("missing-index", "index.md") not in found and got["more"] == 0
    assert sum(d["rule"] == "schema-not-allowed" for d in got["diagnostics"]) == 2  # an item of a list, and a number


def test_replay(spark, folder):
    e = Engine.open_folder(spark, folder)
    cases = [
        {"id": "1", "cat": "list", "calls": [{"tool": "query", "args": {"status": "stable"}}], "expect": {"ids": ["a"], "rank": {"id": "a", "k": 1}}, "baseline": "pass"},
        {"id": "2", "cat": "sheet", "calls": [{"tool": "data_query", "args": {"sql": "SELECT sum(a) AS s FROM t"}}], "expect": {"values": [1]}, "baseline": "fail"},
        {"id": "3", "cat": "list", "calls": [{"tool": "get", "args": {"id": "none"}}], "expect": {}, "baseline": "pass"},
    ]
    from marginalia.operators.sample import category_results

    assert {r["category"]: tuple(r)[1:] for r in category_results(e.replay(cases)).collect()} == {"list": (2, 1, 1, 0), "sheet": (1, 1, 0, 1)}


def test_sync_folder(spark, tmp_path):
    import os

    from marginalia.operators.sync import State

    root, state = tmp_path / "kb", State(spark, str(tmp_path / "state"))
    assert files.scaffold(str(root)) == ["index.md", "_meta/vocabulary.md"] and files.scaffold(str(root)) == []
    assert files.new_document(str(root), "p", "Đổi trả + more", "Policy", "2026-01-01") == "p/doi-tra-more.md"
    with pytest.raises(FileExistsError):
        files.new_document(str(root), "p", "Đổi trả + more", "Policy", "2026-01-01")
    (root / "p" / "a b+c%[1].md").write_text("old")
    assert files.sync_folder(spark, str(root), state) == {"new": 4}
    version = state.current()["version"]
    assert files.sync_folder(spark, str(root), state) == {"unchanged": 4} and state.current()["version"] == version
    (root / "p" / "a b+c%[1].md").write_text("newer")
    (root / "index.md").unlink()
    os.utime(root / "p" / "doi-tra-more.md", (1, 1))
    assert files.sync_folder(spark, str(root), state) == {"changed": 1, "removed": 1, "touched": 1, "unchanged": 1}
    got = {r["id"]: r["body"] for r in state.read("docs").collect()}
    assert sorted(got) == ["_meta/vocabulary", "p/a b+c%[1]", "p/doi-tra-more"] and got["p/a b+c%[1]"] == "newer"


def test_datasets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,Name\n1,x\n")
    (tmp_path / "b.tsv").write_text("Id\tN\n1\t2.5\n")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.csv").write_text("x\n1\n")
    (tmp_path / "w.xlsx").write_bytes(workbook())
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "old.xls").write_bytes(b"x")
    tables, sources, labels, skipped = files.datasets(spark, str(tmp_path))
    assert sorted(tables) == ["a", "b", "w"] and sources["a"] == "a.csv" and labels["a"] == {"id": "Id", "name": "Name"}
    assert [tuple(r) for r in tables["b"].collect()] == [(1, 2.5)] and sorted(p for p, _ in skipped) == ["bad.xlsx", "old.xls", "s/a.csv"]


def test_names():
    assert [tabular.sql_name(x) for x in ("Đơn Giá (VND)", "", "2026", "a--b")] == ["don_gia_vnd", "col", "c_2026", "a_b"]
    assert tabular.unique(["a", "a", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]
    assert tabular.table_name("x/My Sheet.xlsx", "One", 2) == "my_sheet__one" and tabular.table_name("x/sales.csv") == "sales"


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('\ufeffId,Id,Code,Big,Real,Void\n1,a,007,9223372036854775808,1.5,\n2,"b, c",010,1,2e3,\n\n3,d\n')
    df, head = tabular.read_delimited(spark, str(p))
    assert head == ["Id", "Id", "Code", "Big", "Real", "Void"] and df.columns == ["id", "id_2", "code", "big", "real", "void"]
    assert tabular.infer(df) == {"id": "bigint", "id_2": "string", "code": "string", "big": "double", "real": "double", "void": "string"}
    rows = tabular.typed(df).orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3] and rows[1]["id_2"] == "b, c" and rows[2]["real"] is None


def workbook() -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Name</t></si><si><t>Day</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>3</v></c><c r="C2" s="1"><v>45000</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook())
    got = tabular.read_workbook(spark, str(tmp_path / "w.xlsx"))
    df, head = got["w"]
    assert head == ["Name", "", "Day"] and [tuple(r) for r in df.collect()] == [("3", None, "2023-03-15")]


def test_html():
    page = "<html><head><title> T </title><style>x</style></head><body><nav>menu</nav><main><h2>A <b>b</b></h2><p>x &amp; y<br>z</p><ul><li>one</li><li>two</li></ul><table><tr><th>h|</th></tr><tr><td>1</td><td>2</td></tr></table><pre>c  d</pre></main><footer>f</footer></body></html>"
    md, title = files.html_to_markdown(page)
    assert title == "T" and md == "## A **b**\n\nx & y\nz\n\n- one\n- two\n\n| h\\| |  |\n| --- | --- |\n| 1 | 2 |\n\n```\nc  d\n```\n"
    assert files.html_to_markdown("")[0] == "\n" and files.html_to_markdown("<p>a")[0] == "a\n"
    assert files.convert("a.pdf", b"x")[2] and files.convert("a.txt", b"t")[0] == "t"
    files.html_to_markdown("<div>" * 3000)


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
ODF = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0"'


def test_office_documents(spark, tmp_path):
    p = lambda text, pr="": f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    item = '<w:numPr><w:ilvl w:val="0"/></w:numPr>'
    word = archive(word__document_dot_xml=f"<w:document {W}><w:body>{p('Top', '<w:pStyle w:val=\"Heading1\"/>')}{p('Some text.')}{p('one', item)}{p('two', item)}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b|c')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc></w:tr></w:tbl></w:body></w:document>", docProps__core_dot_xml='<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>The title</dc:title></c>')
    assert files.convert("x.docx", word) == ("# Top\n\nSome text.\n\n- one\n- two\n\n| a | b\\|c |\n| --- | --- |\n| 1 |  |\n", "The title", None)
    odt = archive(content_dot_xml=f'<office:document-content {ODF}><office:body><office:text><text:h text:outline-level="2">Head</text:h><text:p>A<text:s text:c="2"/>b <text:span>c</text:span></text:p><text:list><text:list-item><text:p>x</text:p></text:list-item></text:list></office:text></office:body></office:document-content>')
    assert files.convert("x.odt", odt)[0] == "## Head\n\nA  b c\n\n- x\n"
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    slide = f'<p:sld {a}><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Deck</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>one</a:t></a:r></a:p><a:p><a:r><a:t>two</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'
    assert files.convert("x.pptx", archive(ppt__slides__slide1_dot_xml=slide))[0] == "## Deck\n\n- one\n- two\n"
    book = archive(**{"META-INF__container_dot_xml": '<c><rootfile full-path="o/b.opf"/></c>', "o__b_dot_opf": '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Book</dc:title><item id="i" href="c.xhtml"/><itemref idref="i"/></package>', "o__c_dot_xhtml": "<html><body><h1>One</h1><p>text</p></body></html>"})
    assert files.convert("x.epub", book) == ("# One\n\ntext\n", "Book", None)
    assert files.convert("x.rtf", rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Caf\'e9 \u8364?\par {\b bold}{\*\x y}}")[0] == "Caf\u00e9 \u20ac\n\nbold\n"
    for name in ("x.docx", "x.pptx", "x.odt", "x.epub", "x.rtf"):
        assert files.convert(name, b"nothing")[2] and files.convert(name, archive(a="b"))[2]
    cell = lambda v: f'<table:table-cell office:value-type="float" office:value="{v}"/>'
    text = lambda v: f"<table:table-cell><text:p>{v}</text:p></table:table-cell>"
    ods = archive(content_dot_xml=f'<office:document-content {ODF}><table:table table:name="S"><table:table-row>{text("Id")}{text("Name")}</table:table-row><table:table-row>{cell(1)}{text("x")}<table:table-cell table:number-columns-repeated="16000"/></table:table-row><table:table-row table:number-rows-repeated="1000000"><table:table-cell/></table:table-row></table:table></office:document-content>')
    (tmp_path / "b.ods").write_bytes(ods)
    tables, _, _, skipped = files.datasets(spark, str(tmp_path))
    assert not skipped and [r.asDict() for r in tables["b"].collect()] == [{"id": 1, "name": "x"}]
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert files.html_to_markdown(deep)[0].strip() == "deep"


def test_pages_and_folders(spark):
    src = spark.createDataFrame([("a.pdf", "h1", [1, 3]), ("b.pdf", "h2", [])], "path string, hash string, needs_ocr array<int>")
    assert [(r["path"], r["page"]) for r in files.pending_pages(src).collect()] == [("a.pdf", 1), ("a.pdf", 3)]
    done = spark.createDataFrame([("h1", 1), ("h9", 3)], "hash string, page int")
    assert {r["path"]: r["needs_ocr"] for r in files.with_transcripts(src, done).collect()} == {"a.pdf": [3], "b.pdf": []}
    a, b = {"top": "a", "docs": 5, "kind": "partial"}, {"top": "b", "docs": 9, "kind": "markdown"}
    assert files.best_folder([b, a]) == a and files.best_folder([a, {**a, "top": "c"}]) is None and files.best_folder([]) is None


def test_streams(spark, folder, tmp_path):
    seen = []
    q = new_files(spark, folder, lambda df, _: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert any(p.endswith("sub/b.md") for p in seen)
    e = spark.createDataFrame([("2026-01-01 00:10:00", "a", 1.0), ("2026-01-01 00:50:00", "a", 2.0), ("2026-01-01 01:00:00", "b", None)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {(r["event_type"], r["n"], r["total"]) for r in windowed(e).collect()} == {("a", 2, 3.0), ("b", 1, None)}


@pytest.fixture(scope="module")
def duck(data):
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, int | float):
        return float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    return float(v) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    if name not in catalogue.ORACLE:
        assert len({type(r) for r in df.collect()}) <= 1  # runs over all rows
        return
    got = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((repr([_plain(r[names.index(c)]) for c in order]) for r in got.fetchall()))
    assert sorted(repr([_plain(r[c]) for c in order]) for r in df.collect()) == want


def test_entry_points_without_the_training_data_package(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(catalogue.__file__).parents[2]
    shutil.copytree(root / "marginalia", tmp_path / "marginalia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(set(e.oracle_sql()) - set(q)))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    n, rest = out.split(" ", 1)
    assert int(n) > 100 and rest.strip() == "[]" and not re.search(r"\bp\d_", out)
