"""Bounds of the engine. They decide which documents are refused and where text is cut."""

SOURCE_BYTES = 12 * 1024 * 1024
TEXT_CHARS = 90_000
MARKDOWN_CHARS = 500_000
ZIP_ENTRIES = 2_000
ZIP_TOTAL = 100 * 1024 * 1024
ZIP_ENTRY = 25 * 1024 * 1024
ZIP_RATIO = 1_000
XML_EVENTS = 1_000_000
XML_DEPTH = 256
SHEET_ROWS = 100_000
SHEET_CELLS = 1_000_000
INSPECTED_CELLS = 10_000
SHEETS = 50
ASSETS = 12
ASSET_BYTES = 6 * 1024 * 1024
OUTPUT_BYTES = 10_000_000
