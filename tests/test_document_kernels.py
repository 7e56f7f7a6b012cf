"""Kernels on inputs built in memory."""

import io
import struct
import zipfile
import zlib

import pytest

from docframe.kernels import hwp, lines, markdown, reading, rtf, sheets, xmlscan
from docframe.kernels.detecting import zip_format
from docframe.kernels.errors import Refused
from docframe.kernels.package import Package, build, entries, over_budget
from docframe.plans import deck, recognise
from docframe.writers import xlsx
from docframe.writers.documents import WRITERS


def events(x):
    return [(k, n) for k, n, *_ in xmlscan.events(x)]


def test_xml_events():
    assert events("<a><b>hi</b></a>") == [("open", "a"), ("open", "b"), ("text", "hi"), ("close", "b"), ("close", "a")]
    assert events('<a x="1>2"/><!-- <b> -->t') == [("open", "a"), ("text", "t")]
    assert events("<![CDATA[<x>&amp;]]>") == [("text", "<x>&amp;")] and events("<![CDATA[rest") == [("text", "rest")]
    assert events("a<b") == [("text", "a")]
    for bad in ("<!DOCTYPE html>", "<!ENTITY x 'y'>", "<a>" * 257):
        with pytest.raises(Refused):
            list(xmlscan.events(bad))


def test_entities():
    assert xmlscan.decode("&amp;lt;") == "&lt;" and xmlscan.decode("&#54620;&#xAE00;") == "한글"
    assert xmlscan.decode("&unknown;&nbsp;&#xD800;&#x110000;") == "&unknown; "
    text = "a<b>&\"'ü"
    assert xmlscan.decode(xmlscan.escape(text)) == text


def test_lines():
    assert lines.tidy("  a \t b  c | | ") == "a\tb c"
    assert lines.normalize(["", "a", "", " ", "b", ""]) == "a\n\nb"
    assert lines.units("a😀") == 3 and lines.cut("a😀b", 2) == "a" and lines.cut("a😀b", 3) == "a😀"


def test_zip_budget_and_order():
    assert over_budget([]) and over_budget([("a", 1, 1)] * 2001) and over_budget([("a", 1, 26 * 1024 * 1024)])
    assert over_budget([("a", 1, 1001)]) and not over_budget([("a", 1, 1000)]) and over_budget([("a", 10**6, 21 * 1024 * 1024)] * 5)
    for bad in ("../etc/passwd", "/etc/passwd", "a/../../b"):
        assert over_budget([(bad, 1, 1)])
    assert not over_budget([("docProps/app.xml", 1, 1)])
    data = build({"mimetype": "x/y", "b": "2"}, stored=("mimetype",))
    assert data[30:38] == b"mimetype" and data == build({"mimetype": "x/y", "b": "2"}, stored=("mimetype",))
    assert [n for n, *_ in entries(data)] == ["mimetype", "b"]
    assert Package(build({f"s{n}.xml": "" for n in (10, 2, 1)})).numbered(r"s(\d+)\.xml") == ["s1.xml", "s2.xml", "s10.xml"]


def test_columns():
    assert [sheets.column_of(a) for a in ("A1", "Z9", "AA1", "")] == [0, 25, 26, -1]
    assert all(sheets.column_of(sheets.column_name(n)) == n for n in range(20_000))


def workbook(sheet, shared=None, extra=None):
    rels = '<Relationships><Relationship Id="r1" Target="/xl/worksheets/a.xml"/></Relationships>'
    parts = {"xl/workbook.xml": '<workbook><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="veryHidden"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/a.xml": f"<worksheet><sheetData>{sheet}</sheetData></worksheet>", "xl/worksheets/sheet2.xml": "<worksheet/>"}
    if shared:
        parts["xl/sharedStrings.xml"] = shared
    return build(parts | (extra or {}))


def test_workbook_cells():
    data = workbook('<row r="1"><c r="A1" t="s"><v>1</v></c><c r="D1"><f>A1+1</f><v>9</v></c></row><row><c t="e"><v>#N/A</v></c><c t="s"><v></v></c><c t="s"><v>7</v></c></row>', "<sst><si><t>zero</t></si><si><r><t>on</t></r><r><t>e</t></r></si></sst>", {"xl/vbaProject.bin": "x", "xl/externalLinks/externalLink1.xml": "x"})
    got, facts = sheets.read_workbook(data)
    assert [[(c.address, c.value, c.formula, c.error) for c in r] for r in got[0].rows] == [[("A1", "one", None, None), ("D1", "9", "A1+1", None)], [("A2", "#N/A", None, "#N/A"), ("B2", "zero", None, None), ("C2", "", None, None)]]
    assert facts == {"total_sheets": 2, "hidden_sheets": 1, "external_links": 1, "macros": True}
    assert [s.name for s in sheets.read_workbook(data, hidden=True)[0]] == ["S", "H"]
    assert sheets.row_text(got[0].rows[0]) == "one |  |  | 9"


def test_workbook_budget_keeps_whole_rows():
    data = workbook("".join(f'<row><c t="inlineStr"><is><t>{"x" * 20}</t></is></c></row>' for _ in range(50)))
    got = reading.read(data, "xlsx", 200)
    assert got["counts"]["totalRows"] == 50 and 0 < got["counts"]["rows"] < 50 and not got["complete"] and got["text"].endswith("x" * 20)


def test_counts_in_notes_are_plain_numbers():
    data = xlsx.render([{"name": "S", "rows": [[k] for k in range(1200)]}])
    assert reading.read(data, "xlsx", 10_000_000)["note"] == "all 1 visible sheet(s), 1200 row(s)"
    assert reading.read(data, "xlsx", 4000)["note"].endswith(" of 1200 row(s) across 1 visible sheet(s)")


def test_packages_are_as_zipfile_writes_them(monkeypatch):
    from docframe.kernels import package

    parts = {"mimetype": "a/b", "x/한글.xml": "text " * 3000, "empty": b"", "same.xml": "<a/>", "y/same.xml": "<a/>"}
    want = package._build_large({k: v.encode() if isinstance(v, str) else v for k, v in parts.items()}, ("mimetype",))
    assert build(parts, ("mimetype",)) == want
    # parts that every workbook has are packed once
    packed = []
    monkeypatch.setattr(package, "_packed_once", package.lru_cache(64)(lambda b: packed.append(b) or package._packed(b)))
    for k in range(20):
        xlsx.render([{"name": "S", "rows": [[k]]}])
    assert len(packed) <= 8 + 19


def test_xlsx_writer():
    rows = [["Item", "Value"], ["매출", 40], ["비용", 10.5], ["이익", {"formula": "=B2-B3", "cached": 29.5}], ["=literal", True], [None, 1e21]]
    got, _ = sheets.read_workbook(xlsx.render([{"name": "A & B", "rows": rows}]))
    assert [[c.value for c in r] for r in got[0].rows] == [["Item", "Value"], ["매출", "40"], ["비용", "10.5"], ["이익", "29.5"], ["=literal", "1"], ["", "1e+21"]]
    assert got[0].rows[3][1].formula == "B2-B3"
    for bad in ("bad/name", "", "x" * 32, "'q"):
        with pytest.raises(Refused):
            xlsx.render([{"name": bad, "rows": []}])
    with pytest.raises(Refused):
        xlsx.render([{"name": "Data", "rows": []}, {"name": "data", "rows": []}])
    with pytest.raises(Refused):
        xlsx.render([{"name": "a", "rows": [[float("nan")]]}])
    assert [xlsx.number(x) for x in (5.0, 0.1, 1e-7, 1.5e300, -2.5e-5)] == ["5", "0.1", "1e-7", "1.5e+300", "-0.000025"]


def test_odf():
    sheet = '<office:document-content><table:table table:name="T"><table:table-row><table:table-cell><text:p>a</text:p><text:p>b</text:p></table:table-cell><table:table-cell/><table:table-cell><text:p>c<text:s text:c="3"/>d</text:p></table:table-cell></table:table-row></table:table></office:document-content>'
    data = build({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": sheet}, stored=("mimetype",))
    assert zip_format(data) == ("odf", None)
    assert reading.read(data, "odf")["text"] == "## T\nab | c d" and reading.read(data, "odf")["counts"] == {"sheets": 1}
    text = build({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": "<text:h>H</text:h><text:p>x<text:line-break/>y</text:p>"})
    assert reading.read(text, "odf")["text"] == "H\nx\ny" or reading.read(text, "odf")["text"] == "H\nx y"


def test_rtf():
    src = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator X;}Caf\'e9 " + b"\\" + b"u-10916?" + b"\\" + rb"u44032? \{ok\}\par a\cell b\cell\row x\tab y}"
    assert lines.normalize(rtf.text_of(src).split("\n")) == "Caf" + chr(0xE9) + " " + chr(65536 - 10916) + chr(44032) + " {ok}\na | b\nx\ty"
    assert rtf.text_of(b"plain") is None


def record(tag, payload):
    n = len(payload)
    return struct.pack("<I", tag | (min(n, 0xFFF) << 20)) + (struct.pack("<I", n) if n >= 0xFFF else b"") + payload


def compound(files):
    """A small compound file: every stream in the mini stream."""
    pool, mini, dirs = b"", [], []
    storages = sorted({p.rpartition("/")[0] for p in files if "/" in p})
    nodes = [("Root Entry", 5, 0, b"")]
    for s in storages:
        nodes.append((s, 1, 0, b""))
    for p, body in files.items():
        nodes.append((p.rpartition("/")[2], 2, storages.index(p.rpartition("/")[0]) + 1 if "/" in p else 0, body))
    starts = {}
    for i, (_, kind, _, body) in enumerate(nodes):
        if kind == 2:
            starts[i] = len(pool) // 64
            n = max(1, -(-len(body) // 64))
            mini += [*range(starts[i] + 1, starts[i] + n), 0xFFFFFFFE]
            pool += body.ljust(n * 64, b"\0")
    pool = pool.ljust(-(-len(pool) // 512) * 512, b"\0")
    n_pool = len(pool) // 512
    minifat = struct.pack(f"<{len(mini)}I", *mini).ljust(512, b"\xff")
    assert len(minifat) == 512
    children = {i: [k for k, x in enumerate(nodes) if k and x[2] == i] for i in range(len(nodes))}
    right = {}
    for kids in children.values():
        right |= dict(zip(kids, kids[1:]))
    for i, (name, kind, _, body) in enumerate(nodes):
        raw = name.encode("utf-16-le")
        kid = children[i][0] if children[i] and kind != 2 else 0xFFFFFFFF
        start, size = (3, len(pool)) if i == 0 else (starts.get(i, 0), len(body))
        dirs.append(raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw) + 2, kind, 1, 0xFFFFFFFF, right.get(i, 0xFFFFFFFF), kid) + b"\0" * 36 + struct.pack("<III", start, size, 0))
    directory = b"".join(dirs)
    n_dir = -(-len(directory) // 512)
    directory = directory.ljust(n_dir * 512, b"\0")
    # sectors: 0 FAT, 1 mini FAT, 2 unused, 3.. mini stream, then the directory
    fat = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFF, *[3 + k + 1 for k in range(n_pool - 1)], 0xFFFFFFFE, *[3 + n_pool + k + 1 for k in range(n_dir - 1)], 0xFFFFFFFE]
    head = hwp.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<8I", 1, 3 + n_pool, 0, 4096, 1, 1, 0xFFFFFFFE, 0) + struct.pack("<I", 0) + b"\xff" * 432
    return head + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + minifat + b"\0" * 512 + pool + directory


def test_hwp():
    units = lambda *x: struct.pack(f"<{len(x)}H", *x)
    assert hwp.paragraph(units(65, 10, 66, 30, 67, 24, 68)) == "A\nB C-D"
    assert hwp.paragraph(units(65, 2, 0, 0, 0, 0, 0, 0, 2, 66)) == "AB" and hwp.paragraph(units(9, 0, 0, 0, 0, 0, 0, 9, 66)) == "\tB"
    assert hwp.paragraph(units(65) + b"x") == "A"
    long = "가".encode("utf-16-le") * 3000
    assert hwp.paragraphs(record(66, b"zz") + record(67, long) + record(67, units(65)) + struct.pack("<I", 67 | 100 << 20)) == ["가" * 3000, "A"]
    head = b"HWP Document File".ljust(32, b"\0") + bytes([0, 3, 0, 5]) + struct.pack("<I", 1)
    pack = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(9, zlib.DEFLATED, -15))
    files = {"FileHeader": head.ljust(256, b"\0"), "BodyText/Section10": pack(record(67, units(67, 13))), "BodyText/Section2": pack(record(67, units(65, 13)) + record(67, units(66, 13)))}
    got = reading.read(compound(files), "hwp")
    assert got["text"] == "A\n\nB\n\nC" or got["text"] == "A\nB\nC"
    assert got["counts"] == {"sections": 2} and "5.0.3.0" in got["note"]
    for flag in (2, 4):
        with pytest.raises(Refused):
            hwp.lines(compound(files | {"FileHeader": head[:36] + struct.pack("<I", flag)}))
    with pytest.raises(Refused):
        hwp.lines(compound({"WordDocument": b"x"}))


def test_markdown_blocks():
    kinds = lambda s: [(b["kind"], markdown.text_of(b)) for b in markdown.parse(s)]
    assert kinds("a\nb\n\n***\n> q\n> r\n~~~py\nx") == [("paragraph", "a b"), ("rule", ""), ("quote", "q r"), ("code", "x")]
    assert kinds("- a\n1. b") == [("list", "a"), ("list", "b")]
    assert kinds("| a |\n|---|") == [("paragraph", "| a | |---|")]
    assert kinds("p\na | b\n--|--") [0][0] == "paragraph"
    t = markdown.parse("a | b\n:-:|--:\n1 | x\\|y")[0]
    assert t["align"] == ["center", "right"] and markdown.text_of(t) == "a | b\n1 | x|y"
    assert [b["kind"] for b in markdown.parse(":::cards\n### a\n:::\nz")] == ["directive", "heading", "paragraph"]
    assert markdown.summary(markdown.parse("# T\n\np\n\nq\n\n- x\n\n|a|b|\n|-|-|\n")) == "1 heading, 2 paragraphs, 1 table, 1 list" and markdown.summary([]) == "nothing"


def test_markdown_inline():
    shown = lambda s: [(r["text"], "".join(k[0] for k in ("bold", "italic", "code") if r[k]), r["href"]) for r in markdown.inline(s)]
    assert shown("a **b _c_** `d*` snake_case_name") == [("a ", "", None), ("b ", "b", None), ("c", "bi", None), (" ", "", None), ("d*", "c", None), (" snake_case_name", "", None)]
    assert shown(r"\*x\* [](u) ![](p)") == [("*x* ", "", None), ("u", "", "u"), (" ", "", None), ("image", "", "p")]
    assert shown("a * b") == [("a * b", "", None)]


def parse(s):
    return markdown.parse(s)


def test_recognition():
    r = lambda s, t="": (recognise.recognise(parse(s), t) or {}).get("kind")
    assert r("### a\nx\n### b\ny") == "cards" and r("### a\n" + "x" * 161 + "\n### b\ny") is None and r("### a") is None
    assert r("- 12% growth\n- users 3,000") == "metrics" and r("- no figure\n- none here") is None and r("- 1 a\n  - 2 b") is None
    assert r("> q\n\n— me") == "quote" and r("> q\n\nme") is None
    assert r("### x\n- a\n### y\n- b", "X vs Y") == "comparison" and r("### x\n- a\n### y\n- b", "plain") is None
    assert r("1. 2021 a\n2. Q3 b\n3. 8월 c") == "timeline" and r("1. a\n2. b\n3. c") == "process" and r("1. a\n2. b") is None
    assert recognise.force("comparison", parse("### x\n- a\n### y\n- b"))["kind"] == "comparison" and recognise.force("other", []) is None


def test_packing():
    bullets = parse("## T\n\n" + "\n".join(f"- item {i}" for i in range(20)))
    slides = deck.plan(bullets)
    assert [s["title"] for s in slides] == ["T", "T (계속)"] and sum(len(s["pieces"]) for s in slides) == 20
    table = deck.plan(parse("## T\n\n|a|b|\n|-|-|\n" + "\n".join(f"|{i}|x|" for i in range(20))))
    assert len(table) > 1 and all(s["pieces"][0]["header"] == ["a", "b"] for s in table) and sum(len(s["pieces"][0]["rows"]) for s in table) == 20
    late = deck.plan(parse("## T\n\n" + "\n".join(f"- item {i}" for i in range(10)) + "\n\n### topic\n\nbody body\n\nmore"))
    assert late[1]["title"] == "T — topic"
    assert [s["type"] for s in deck.plan(parse("# C\nsub\n\n## A\n\np\n\n# Two\n\n## Thank you\n\nbye"))] == ["cover", "content", "section", "closing"]


@pytest.mark.parametrize("form", ["docx", "hwpx", "pptx"])
def test_writers_read_back(form):
    source = "# Title & more\n\nFirst **bold** line\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode <x>\n```\n"
    data = WRITERS[form](parse(source), "Title", "executive")
    assert data == WRITERS[form](parse(source), "Title", "executive")
    assert zip_format(data) == (form, None)
    text = reading.read(data, form)["text"]
    for piece in ("Title & more", "First bold line", "one", "two", "1 | 2", "code <x>"):
        assert piece in text
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None


def test_pdf():
    data = WRITERS["pdf"](parse("# T\n\n" + "\n\n".join(f"Paragraph {i} (with parens)" for i in range(120))), "T")
    assert data.startswith(b"%PDF-1.7") and data.rstrip().endswith(b"%%EOF") and data.count(b"/Type /Page /Parent") > 2
    at = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    assert data[at : at + 4] == b"xref"


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\0\0\0" + b"\0" * 4


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9 + b"\xff\xd9"


def test_images():
    from docframe.kernels import images

    assert images.size(png(640, 400)) == (640, 400) and images.size(jpeg(320, 200)) == (320, 200) and images.size(b"GIF89a") is None
    assert images.fit((100, 50), (50, 50)) == (50, 25) and images.fit((10, 10), (50, 50)) == (10, 10)
    b = parse("![cap](asset://pic) \n\ntext ![x](asset://pic)")
    assert images.figure(b[0]) == ("pic", "cap") and images.figure(b[1]) is None
    with pytest.raises(Refused):
        images.figures(b, {})


@pytest.mark.parametrize("form", ["docx", "pptx", "pdf"])
def test_pictures_are_embedded_once(form):
    blocks = parse("# T\n\n## A\n\n![cap](asset://pic)\n\n![again](asset://pic)\n\n![png](asset://two)")
    data = WRITERS[form](blocks, "T", "formal", {"pic": jpeg(640, 400), "two": png(30, 20)})
    if form == "pdf":
        assert data.count(b"/DCTDecode") == 1
        return
    names = [n for n, *_ in entries(data)]
    assert sum("/media/" in n for n in names) == 2
    p = Package(data)
    from docframe.operators.kernels import _relationships

    assert all(out or target in p.names for _, target, out in _relationships(p))
    assert "cap" in reading.read(data, form)["text"]


def test_contents_need_a_cover_and_three_entries():
    from docframe.writers.documents import toc

    assert toc(parse("# T\n\n## a\n\n## b\n\n# c")) == [(2, "a"), (2, "b"), (1, "c")]
    assert toc(parse("# T\n\n## a\n\n## b")) == [] and toc(parse("p\n\n# T\n\n## a\n\n## b\n\n## c")) == []


def test_asset_rules():
    from docframe.operators.kernels import refused_assets

    ok = {"a.png": ("image/png", 10)}
    assert refused_assets(ok, "docx") is None and refused_assets(ok, "hwpx") and refused_assets({"a b": ("image/png", 1)}, "pdf")
    assert refused_assets({"a": ("image/gif", 1)}, "pdf") and refused_assets({"a": ("image/png", 7 * 1024 * 1024)}, "pdf") and refused_assets({str(i): ("image/png", 1) for i in range(13)}, "pdf")


def test_broken_relationships_are_reported(tmp_path):
    data = WRITERS["docx"](parse("# T"), "T")
    p = zipfile.ZipFile(io.BytesIO(data))
    parts = {n: p.read(n) for n in p.namelist() if n != "word/styles.xml"}
    from docframe.kernels.package import build as rebuild
    from docframe.operators.kernels import _relationships

    broken = Package(rebuild(parts))
    assert [t for _, t, out in _relationships(broken) if not out and t not in broken.names] == ["word/styles.xml"]


def test_plain_sheets_and_packages_read_as_any_other():
    import random
    import re

    from docframe.kernels import package

    def said(f, *args):
        try:
            return f(*args)
        except Refused as e:
            return e.code, e.message

    rnd, plain = random.Random(5), 0
    bits = ["<!-- x -->", "<![CDATA[<v>9</v>]]>", "<", ">", '"', "'", "&amp;", "&#65;", "<row/>", "<row r=\"0\">", "</row>", "<c/>", "<c r=\"a1\"><v>2</v></c>", "</c>", "<v>", "</v>", "<sheetData>", "</sheetData>", "<!DOCTYPE x>", "<f>1</f>", " ", "\n", "<is><t>y</t></is>", "<v></v>", '<c r="B2" t="s"><v> 1 </v></c>', '<c r="C9" t="e"><v>#N/A</v></c>']
    for k in range(1500):
        rows = [[rnd.choice([None, 1.5, 7, "a&b <c>", "", True, {"formula": "=A1<2", "cached": "x"}, {"formula": "B1"}]) for _ in range(rnd.randint(0, 4))] for _ in range(rnd.randint(1, 4))]
        xml = Package(xlsx.render([{"name": "S", "rows": rows}])).text("xl/worksheets/sheet1.xml")
        for _ in range(k % 4):
            at = rnd.choice([m.end() for m in re.finditer(">", xml)] + [rnd.randrange(len(xml))])
            xml = xml[:at] + rnd.choice(bits) + xml[at + rnd.choice([0, 0, 0, 3]) :]
        got = sheets._plain_sheet(xml, ["zero", "one"])
        plain += got is not None
        assert got is None or got == said(sheets._scanned_sheet, xml, ["zero", "one"])
        assert said(sheets.parse_sheet, xml, ["zero", "one"]) == said(sheets._scanned_sheet, xml, ["zero", "one"])
    assert plain > 400
    data = bytearray(xlsx.render([{"name": "S", "rows": [["text " * 50, 1]]}]))
    assert package._plainly_listed(bytes(data)) is not None
    for _ in range(3000):  # a byte changed: never read otherwise than by zipfile
        bad = bytearray(data)
        bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        listed = package._plainly_listed(bytes(bad))
        for part in listed or ():
            body = package._plainly_read(bytes(bad), part)
            assert body is None or body == zipfile.ZipFile(io.BytesIO(bytes(bad))).read(part[0])
        assert listed is None or [p[:3] for p in listed] == entries(bytes(bad))
