"""Markdown blocks to DOCX, HWPX, PPTX and PDF. Layout is plain; structure and text are complete."""

from __future__ import annotations

import zlib

from docframe.kernels.images import extension, figures, fit
from docframe.kernels.markdown import plain
from docframe.kernels.package import build
from docframe.plans.deck import plan
from docframe.writers.common import HEAD, PROFILES, PROPERTY_LINKS, PROPERTY_TYPES, REL, column_shares, content_types, properties, relationships, round_half_up, xml

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"


TOC_LEAST = 3


def flat(blocks: list[dict]) -> list[dict]:
    return [b for b in blocks if b["kind"] != "directive"]


def toc(blocks: list[dict]) -> list[tuple[int, str]]:
    """(level, text) of the headings after a cover, if there is a cover and enough of them."""
    heads = [b for b in blocks if b["kind"] == "heading" and b["level"] <= 2 and b["depth"] == 0]
    if not heads or heads[0]["pos"] != 0 or heads[0]["level"] != 1 or len(heads) - 1 < TOC_LEAST:
        return []
    return [(b["level"], plain(b["runs"])) for b in heads[1:]]


# --- DOCX ---------------------------------------------------------------------------------------


def docx(blocks: list[dict], title: str, profile: str = "executive", assets: dict[str, bytes] | None = None) -> bytes:
    body_pt, head_pt, accent, ink = PROFILES[profile]
    links: dict[str, str] = {}
    pictures = figures(blocks, assets or {})
    media: dict[str, tuple[str, bytes]] = {}  # by asset name: relationship and bytes, each once

    def runs(items: list[dict]) -> str:
        out = []
        for r in items:
            props = ("<w:b/>" if r["bold"] else "") + ("<w:i/>" if r["italic"] else "") + ('<w:rFonts w:ascii="Consolas" w:hAnsi="Consolas"/>' if r["code"] else "")
            run = f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{xml(r["text"])}</w:t></w:r>'
            if r["href"]:
                key = links.setdefault(r["href"], f"rId{len(links) + 10}")
                run = f'<w:hyperlink r:id="{key}">{run}</w:hyperlink>'
            out.append(run)
        return "".join(out)

    def para(inner: str, props: str = "") -> str:
        return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}{inner}</w:p>'

    def table(b: dict) -> str:
        rows = [b["header"], *b["rows"]]
        shares = column_shares([[plain(c) for c in r] for r in rows])
        line = lambda r: "<w:tr>" + "".join(f'<w:tc><w:tcPr><w:tcW w:w="{round_half_up(9000 * shares[k])}" w:type="dxa"/></w:tcPr>{para(runs(c))}</w:tc>' for k, c in enumerate(r)) + "</w:tr>"
        grid = "".join(f'<w:gridCol w:w="{round_half_up(9000 * s)}"/>' for s in shares)
        return f'<w:tbl><w:tblPr><w:tblW w:w="9000" w:type="dxa"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{"".join(map(line, rows))}</w:tbl>'

    def picture(b: dict) -> str:
        name, caption, data, natural = pictures[b["pos"]]
        key, _ = media.setdefault(name, (f"rIdM{len(media) + 1}", data))
        w, h = (round_half_up(x * 9525) for x in fit(natural, (600, 700)))
        n = len(media)
        shape = f'<pic:pic xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:nvPicPr><pic:cNvPr id="{n}" name="{xml(name)}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{key}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>'
        drawing = f'<w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="{_A}"><wp:extent cx="{w}" cy="{h}"/><wp:docPr id="{n}" name="{xml(name)}" descr="{xml(caption)}"/><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture">{shape}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
        return para(drawing) + para(f"<w:r><w:t>{xml(caption)}</w:t></w:r>")

    out, listed = [], toc(blocks)
    for b in flat(blocks):
        k = b["kind"]
        if b["pos"] in pictures:
            out.append(picture(b))
        elif k == "heading":
            out.append(para(runs(b["runs"]), f'<w:pStyle w:val="Heading{b["level"]}"/>'))
            if b["pos"] == 0 and listed:
                out += [para(f"<w:r><w:t>{xml(t)}</w:t></w:r>", f'<w:pStyle w:val="Contents{n}"/>') for n, t in listed]
        elif k == "list":
            out += [para(runs(i["runs"]), f'<w:numPr><w:ilvl w:val="{i["depth"]}"/><w:numId w:val="{2 if b["ordered"] else 1}"/></w:numPr>') for i in b["items"]]
        elif k == "table":
            out.append(table(b))
        elif k == "code":
            out += [para(f'<w:r><w:t xml:space="preserve">{xml(x)}</w:t></w:r>', '<w:pStyle w:val="Code"/>') for x in b["text"].split("\n")]
        elif k == "rule":
            out.append(para("", '<w:pBdr><w:bottom w:val="single" w:sz="6"/></w:pBdr>'))
        else:
            out.append(para(runs(b["runs"]), '<w:pStyle w:val="Quote"/>' if k == "quote" else ""))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:rPr><w:b/><w:color w:val="{accent}"/><w:sz w:val="{round_half_up(2 * max(body_pt, head_pt - 3 * (n - 1)))}"/></w:rPr></w:style>' for n in range(1, 7))
    styles += "".join(f'<w:style w:type="paragraph" w:styleId="{n}"><w:name w:val="{n}"/></w:style>' for n in ("Quote", "Code", "Contents1", "Contents2"))
    level = lambda fmt, text: "".join(f'<w:lvl w:ilvl="{d}"><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text.format(d + 1)}"/></w:lvl>' for d in range(5))
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{n}">{level(f, t)}</w:abstractNum>' for n, f, t in ((0, "bullet", "•"), (1, "decimal", "%{}."))) + "".join(f'<w:num w:numId="{n + 1}"><w:abstractNumId w:val="{n}"/></w:num>' for n in (0, 1))
    kind = "officedocument.wordprocessingml."
    return build({
        "[Content_Types].xml": content_types({"word/document.xml": f"{kind}document.main+xml", "word/styles.xml": f"{kind}styles+xml", "word/numbering.xml": f"{kind}numbering+xml"} | PROPERTY_TYPES, tuple(sorted({extension(d) for _, d in media.values()}))),
        "_rels/.rels": relationships([("rId1", f"{REL}/officeDocument", "word/document.xml", False), *PROPERTY_LINKS]),
        **properties(title),
        "word/document.xml": f'{HEAD}<w:document xmlns:w="{_W}" xmlns:r="{REL}"><w:body>{"".join(out)}</w:body></w:document>',
        "word/_rels/document.xml.rels": relationships([("rId1", f"{REL}/styles", "styles.xml", False), ("rId2", f"{REL}/numbering", "numbering.xml", False), *[(i, f"{REL}/hyperlink", to, True) for to, i in links.items()], *[(key, f"{REL}/image", f"media/image{n}.{extension(d)}", False) for n, (key, d) in enumerate(media.values(), 1)]]),
        **{f"word/media/image{n}.{extension(d)}": d for n, (_, d) in enumerate(media.values(), 1)},
        "word/styles.xml": f'{HEAD}<w:styles xmlns:w="{_W}"><w:docDefaults><w:rPrDefault><w:rPr><w:color w:val="{ink}"/><w:sz w:val="{round_half_up(2 * body_pt)}"/></w:rPr></w:rPrDefault></w:docDefaults>{styles}</w:styles>',
        "word/numbering.xml": f'{HEAD}<w:numbering xmlns:w="{_W}">{numbering}</w:numbering>',
    })


# --- HWPX ---------------------------------------------------------------------------------------


def hwpx(blocks: list[dict], title: str, profile: str = "executive", assets: dict[str, bytes] | None = None) -> bytes:
    """Pictures stay links: the format's one consumer could not be tried."""
    ns = 'xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section" xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph" xmlns:hh="http://www.hancom.co.kr/hwpml/2011/head"'
    para = lambda text: f'<hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0"><hp:t>{xml(text)}</hp:t></hp:run></hp:p>'
    out = []
    for b in flat(blocks):
        if b["kind"] == "list":
            counters: list[int] = []
            for i in b["items"]:
                counters = (counters + [0] * 5)[: i["depth"] + 1]
                counters[-1] += 1
                out.append(para(("  " * i["depth"]) + (f"{counters[-1]}. " if b["ordered"] else "• ") + plain(i["runs"])))
        elif b["kind"] == "table":
            rows = [b["header"], *b["rows"]]
            out.append('<hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0"><hp:tbl>' + "".join("<hp:tr>" + "".join(f"<hp:tc><hp:subList>{para(plain(c))}</hp:subList></hp:tc>" for c in r) + "</hp:tr>" for r in rows) + "</hp:tbl></hp:run></hp:p>")
        elif b["kind"] == "code":
            out += [para(x) for x in b["text"].split("\n")]
        elif b["kind"] != "rule":
            out.append(para(plain(b["runs"])))
            if b["pos"] == 0:
                out += [para(t) for _, t in toc(blocks)]
    return build({
        "mimetype": "application/hwp+zip",
        "version.xml": f'{HEAD}<hv:HCFVersion xmlns:hv="http://www.hancom.co.kr/hwpml/2011/version" major="5" minor="1"/>',
        "META-INF/container.xml": f'{HEAD}<container><rootfiles><rootfile full-path="Contents/content.hpf" media-type="application/hwpml-package+xml"/></rootfiles></container>',
        "META-INF/manifest.xml": f'{HEAD}<odf:manifest xmlns:odf="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"/>',
        "Contents/content.hpf": f'{HEAD}<package><metadata><title>{xml(title)}</title></metadata><manifest><item id="header" href="Contents/header.xml"/><item id="section0" href="Contents/section0.xml"/></manifest><spine><itemref idref="section0"/></spine></package>',
        "Contents/header.xml": f'{HEAD}<hh:head {ns} version="1.4" secCnt="1"/>',
        "Contents/section0.xml": f'{HEAD}<hs:sec {ns}>{"".join(out)}</hs:sec>',
    }, stored=("mimetype",))


# --- PPTX ---------------------------------------------------------------------------------------


def pptx(blocks: list[dict], title: str, profile: str = "executive", assets: dict[str, bytes] | None = None) -> bytes:
    body_pt, head_pt, accent, ink = PROFILES[profile]
    pictures = figures(blocks, assets or {})
    media: dict[str, bytes] = {name: data for name, _, data, _ in pictures.values()}
    number = {name: n for n, name in enumerate(media, 1)}
    slides = plan(blocks, title) or [{"type": "content", "title": title, "pieces": []}]

    def para(text: str, size: float, color: str, indent: int = 0) -> str:
        return f'<a:p><a:pPr lvl="{indent}"/><a:r><a:rPr lang="en-US" sz="{round_half_up(size * 100)}"><a:solidFill><a:srgbClr val="{color}"/></a:solidFill></a:rPr><a:t>{xml(text)}</a:t></a:r></a:p>'

    def box(n: int, y: int, h: int, inner: str) -> str:
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="Box {n}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="609600" y="{y}"/><a:ext cx="10972800" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr/>{inner}</p:txBody></p:sp>'

    def table(n: int, y: int, p: dict) -> str:
        rows = [p["header"], *p["rows"]]
        shares = column_shares(rows)
        grid = "".join(f'<a:gridCol w="{round_half_up(10972800 * s)}"/>' for s in shares)
        line = lambda r: '<a:tr h="462915">' + "".join(f"<a:tc><a:txBody><a:bodyPr/>{para(c, body_pt + 1, ink)}</a:txBody><a:tcPr/></a:tc>" for c in r) + "</a:tr>"
        return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{n}" name="Table {n}"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm><a:off x="609600" y="{y}"/><a:ext cx="10972800" cy="{462915 * len(rows)}"/></p:xfrm><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table"><a:tbl><a:tblGrid>{grid}</a:tblGrid>{"".join(map(line, rows))}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'

    def picture(n: int, y: int, name: str, natural: tuple[int, int]) -> tuple[str, int]:
        w, h = (round_half_up(x * 9525) for x in fit(natural, (1152, 480)))
        return f'<p:pic><p:nvPicPr><p:cNvPr id="{n}" name="{xml(name)}"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rIdM{number[name]}"/><a:stretch><a:fillRect/></a:stretch></p:blipFill><p:spPr><a:xfrm><a:off x="609600" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic>', h

    def slide(s: dict) -> str:
        shapes = [box(2, 457200, 914400, para(s["title"], head_pt, accent))]
        y = 1600200
        texts: list[str] = []
        for p in s.get("pieces", []):
            if p.get("pos") in pictures:
                name, caption, _, natural = pictures[p["pos"]]
                shape, h = picture(len(shapes) + 2, y, name, natural)
                shapes.append(shape)
                y += h
                texts.append(para(caption, body_pt + 3, ink))
            elif p["kind"] == "table":
                if texts:
                    shapes.append(box(len(shapes) + 2, y, 400000 * len(texts), "".join(texts)))
                    y, texts = y + 400000 * len(texts), []
                shapes.append(table(len(shapes) + 2, y, p))
                y += 462915 * (len(p["rows"]) + 1)
            else:
                texts.append(para(p["text"], body_pt + 5, ink, p["indent"]))
        texts += [para(x, body_pt + 5, ink, min(k, 1)) for item in s.get("items", []) for k, x in enumerate(item)]
        texts += [para(s["subtitle"], body_pt + 5, ink)] if s.get("subtitle") else []
        if texts:
            shapes.append(box(len(shapes) + 2, y, 400000 * len(texts), "".join(texts)))
        return f'{HEAD}<p:sld xmlns:a="{_A}" xmlns:r="{REL}" xmlns:p="{_P}"><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{"".join(shapes)}</p:spTree></p:cSld></p:sld>'

    empty = f'<p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/></p:spTree></p:cSld>'
    cmap = '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/>'
    colors = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in (("dk1", ink), ("lt1", "FFFFFF"), ("dk2", ink), ("lt2", "EEEEEE"), *[(f"accent{k}", accent) for k in range(1, 7)], ("hlink", "0563C1"), ("folHlink", "954F72")))
    fonts = "".join(f'<a:{n}><a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/></a:{n}>' for n in ("majorFont", "minorFont"))
    fill = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
    theme = f'{HEAD}<a:theme xmlns:a="{_A}" name="Docframe"><a:themeElements><a:clrScheme name="Docframe">{colors}</a:clrScheme><a:fontScheme name="Docframe">{fonts}</a:fontScheme><a:fmtScheme name="Docframe"><a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{f"<a:ln>{fill}</a:ln>" * 3}</a:lnStyleLst><a:effectStyleLst>{"<a:effectStyle><a:effectLst/></a:effectStyle>" * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    ns, kind, top = range(1, len(slides) + 1), "officedocument.presentationml.", f'xmlns:a="{_A}" xmlns:r="{REL}" xmlns:p="{_P}"'
    parts = {
        "[Content_Types].xml": content_types({"ppt/presentation.xml": f"{kind}presentation.main+xml", "ppt/slideMasters/slideMaster1.xml": f"{kind}slideMaster+xml", "ppt/slideLayouts/slideLayout1.xml": f"{kind}slideLayout+xml", "ppt/theme/theme1.xml": "officedocument.theme+xml"} | {f"ppt/slides/slide{i}.xml": f"{kind}slide+xml" for i in ns} | PROPERTY_TYPES, tuple(sorted({extension(d) for d in media.values()}))),
        "_rels/.rels": relationships([("rId1", f"{REL}/officeDocument", "ppt/presentation.xml", False), *PROPERTY_LINKS]),
        **properties(title),
        "ppt/presentation.xml": f'{HEAD}<p:presentation {top}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{"".join(f"<p:sldId id=\"{255 + i}\" r:id=\"rId{i + 1}\"/>" for i in ns)}</p:sldIdLst><p:sldSz cx="12192000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relationships([("rId1", f"{REL}/slideMaster", "slideMasters/slideMaster1.xml", False), *[(f"rId{i + 1}", f"{REL}/slide", f"slides/slide{i}.xml", False) for i in ns]]),
        "ppt/slideMasters/slideMaster1.xml": f'{HEAD}<p:sldMaster {top}>{empty}{cmap}<p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": relationships([("rId1", f"{REL}/slideLayout", "../slideLayouts/slideLayout1.xml", False), ("rId2", f"{REL}/theme", "../theme/theme1.xml", False)]),
        "ppt/slideLayouts/slideLayout1.xml": f'{HEAD}<p:sldLayout {top} type="blank">{empty}</p:sldLayout>',
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": relationships([("rId1", f"{REL}/slideMaster", "../slideMasters/slideMaster1.xml", False)]),
        "ppt/theme/theme1.xml": theme,
    }
    for i, s in enumerate(slides, 1):
        parts[f"ppt/slides/slide{i}.xml"] = slide(s)
        used = sorted({number[pictures[p["pos"]][0]] for p in s.get("pieces", []) if p.get("pos") in pictures})
        parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = relationships([("rId1", f"{REL}/slideLayout", "../slideLayouts/slideLayout1.xml", False), *[(f"rIdM{n}", f"{REL}/image", f"../media/image{n}.{extension(list(media.values())[n - 1])}", False) for n in used]])
    return build(parts | {f"ppt/media/image{n}.{extension(d)}": d for n, d in enumerate(media.values(), 1)})


# --- PDF ----------------------------------------------------------------------------------------


def wrap(text: str, room: int) -> list[str]:
    """Greedy lines of at most ``room`` characters; longer words are cut."""
    out, line = [], ""
    for word in text.split():
        while len(word) > room:
            out += [line] if line else []
            line = ""
            out.append(word[:room])
            word = word[room:]
        if line and len(line) + 1 + len(word) > room:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}" if line and word else line or word
    return out + ([line] if line or not out else [])


def pdf(blocks: list[dict], title: str, profile: str = "executive", assets: dict[str, bytes] | None = None) -> bytes:
    """Pictures keep their captions; JPEG files are drawn. Pages in the standard Latin faces; characters outside Windows-1252 show as ``?`` (no font is shipped)."""
    body_pt, head_pt, *_ = PROFILES[profile]
    rows: list[tuple] = []
    pictures = figures(blocks, assets or {})
    drawn: dict[str, tuple[bytes, tuple[int, int]]] = {}
    for b in flat(blocks):
        if b["pos"] in pictures and extension(pictures[b["pos"]][2]) == "jpg":
            name, _, data, natural = pictures[b["pos"]]
            drawn.setdefault(name, (data, natural))
            rows.append((list(drawn).index(name), fit(natural, (470, 600)), "picture"))
        size = max(body_pt, head_pt - 3 * (b["level"] - 1)) if b["kind"] == "heading" else body_pt
        face = "F2" if b["kind"] == "heading" else "F3" if b["kind"] == "code" else "F1"
        texts = b["text"].split("\n") if b["kind"] == "code" else [("1. " if b["ordered"] else "- ") + plain(i["runs"]) for i in b["items"]] if b["kind"] == "list" else [" | ".join(map(plain, r)) for r in [b["header"], *b["rows"]]] if b["kind"] == "table" else [plain(b.get("runs") or [])]
        rows += [(x, size, face) for t in texts for x in wrap(t, int(470 / (size * 0.5)))] + [("", body_pt / 2, "F1")]
        if b["pos"] == 0:
            rows += [("  " * (n - 1) + t, body_pt, "F1") for n, t in toc(blocks)]
    pages, now, y = [], [], 780.0
    for text, size, face in rows:
        if face == "picture":
            w, h = size
            if y - h < 60 and now:
                pages.append(now)
                now, y = [], 780.0
            y -= h
            now.append(b"q %.1f 0 0 %.1f 60 %.1f cm /P%d Do Q" % (w, h, y, text))
            continue
        if y - size * 1.4 < 60 and now:
            pages.append(now)
            now, y = [], 780.0
        y -= size * 1.4
        if text:
            safe = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            now.append(b"BT /%s %.1f Tf 60 %.1f Td (%s) Tj ET" % (face.encode(), size, y, safe))
    pages.append(now)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (7 + 2 * k) for k in range(len(pages))))]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % f for f in (b"Helvetica", b"Helvetica-Bold", b"Courier")]
    objects.append(b"<< /Title (%s) >>" % title.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)"))
    for k, page in enumerate(pages):
        packed = zlib.compress(b"\n".join(page))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R /F3 5 0 R >> /XObject << %s >> >> /Contents %d 0 R >>" % (b" ".join(b"/P%d %d 0 R" % (n, 7 + 2 * len(pages) + n) for n in range(len(drawn))), 8 + 2 * k))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
    for data, (w, h) in drawn.values():
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (w, h, len(data), data))
    out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for n, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    xref = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Info 6 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, xref))


WRITERS = {"docx": docx, "hwpx": hwpx, "pptx": pptx, "pdf": pdf}
