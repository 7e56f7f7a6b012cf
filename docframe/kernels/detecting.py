"""What a document is, by its bytes first and its name last."""

from __future__ import annotations

import re

from docframe.kernels.errors import Refused
from docframe.kernels.package import entries

# What extensions and MIME types declare, and formats that are named when refused.
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "hwpx": "hwpx", "hwp": "hwp", "xlsx": "xlsx", "pptx": "pptx", "odt": "odf", "ods": "odf", "odp": "odf", "rtf": "rtf"} | dict.fromkeys(("txt", "text", "md", "markdown", "csv", "tsv", "json", "jsonl", "ndjson", "xml", "yaml", "yml", "log", "ini", "toml"), "text")
MIME_TYPES = {
    "application/pdf": "pdf",
    "application/x-pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/hwp+zip": "hwpx",
    "application/vnd.hancom.hwpx": "hwpx",
    "application/haansofthwpx": "hwpx",
    "application/x-hwp": "hwp",
    "application/vnd.hancom.hwp": "hwp",
    "application/haansofthwp": "hwp",
    "application/vnd.oasis.opendocument.text": "odf",
    "application/vnd.oasis.opendocument.spreadsheet": "odf",
    "application/vnd.oasis.opendocument.presentation": "odf",
    "application/rtf": "rtf",
    "text/rtf": "rtf",
} | dict.fromkeys(("application/json", "application/ld+json", "application/xml", "application/yaml", "application/x-yaml", "application/x-ndjson"), "text")
NAMED = {"doc": "a Word 97-2003 document (.doc)", "xls": "an Excel 97-2003 workbook (.xls)", "ppt": "a PowerPoint 97-2003 deck (.ppt)", "epub": "an EPUB book (.epub)"}
PART_FORMATS = (("word/document.xml", "docx"), (r"Contents/section\d+\.xml", "hwpx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"))


def zip_format(data: bytes) -> tuple[str, str | None]:
    """(format, reason) of a zip archive, by the names of its parts."""
    try:
        names = {n for n, *_ in entries(data)}
    except Refused as e:
        return "unsupported", e.message
    for pattern, what in PART_FORMATS:
        if any(re.fullmatch(pattern, n) for n in names):
            return what, None
    if {"content.xml", "mimetype"} <= names:
        return "odf", None
    return "unsupported", NAMED["epub"] if "META-INF/container.xml" in names else "a zip archive of another kind"
