"""Writers: CSV, JSON and text by Spark; workbooks, PNG and PDF as bytes built from bounded results on the driver."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows that a workbook may take from a result; larger results belong in Parquet or CSV.
MAX_SHEET_ROWS = 100_000
_EPOCH = (1980, 1, 1, 0, 0, 0)


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 with CRLF line ends and a header."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_checked(df: DataFrame, violations: DataFrame, path: str) -> None:
    """Writes Parquet only if there are no violations."""
    first = violations.take(3)
    if first:
        raise ValueError(f"not written: {[r.asDict() for r in first]}")
    df.write.mode("overwrite").parquet(path)


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def unique_sheet_names(names: list[str]) -> list[str]:
    """Valid and distinct sheet names: at most 31 characters, repeated ones numbered."""
    out: list[str] = []
    for raw in names:
        base = "".join(" " if c in "\\/*?:[]" else c for c in raw).strip()[:31] or "Sheet"
        name, k = base, 2
        while name.lower() in (x.lower() for x in out):
            tail = f" ({k})"
            name, k = base[: 31 - len(tail)] + tail, k + 1
        out.append(name)
    return out


def _cell(row: int, column: int, v: object) -> str:
    at = f"{column_name(column)}{row}"
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{at}"><v>{v}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """An XLSX file with a sheet per entry; the same rows always give the same bytes."""
    names = unique_sheet_names(list(sheets))
    main, rel, pack = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    ids = range(1, len(names) + 1)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, names, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>",
    }
    for i, rows in zip(ids, sheets.values(), strict=True):
        body = "".join(f'<row r="{r}">' + "".join(_cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, _EPOCH), head + text)
    return out.getvalue()


def usage_workbook(usage: DataFrame, title: str) -> bytes:
    """A usage table as a workbook; refuses results over MAX_SHEET_ROWS."""
    rows = usage.limit(MAX_SHEET_ROWS + 1).collect()
    if len(rows) > MAX_SHEET_ROWS:
        raise ValueError(f"a sheet takes at most {MAX_SHEET_ROWS} rows")
    return workbook({title: [list(usage.columns), *[list(r) for r in rows]]})


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG of 8-bit RGBA pixels."""
    if len(rgba) != 4 * width * height:
        raise ValueError("an image has four bytes for each pixel")
    lines = b"".join(b"\0" + rgba[4 * width * y : 4 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 9)) + _chunk(b"IEND", b"")


def image_pdf(pages: list[tuple[int, int, bytes]], width_mm: float, height_mm: float) -> bytes:
    """A PDF with one JPEG (width, height, bytes) filling each page of exact paper size."""
    w, h = (round(v * 72 / 25.4, 3) for v in (width_mm, height_mm))
    kids = " ".join(f"{3 + 3 * k} 0 R" for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode()]
    for k, (iw, ih, data) in enumerate(pages):
        n = 3 + 3 * k
        draw = f"q {w} 0 0 {h} 0 0 cm /I Do Q".encode()
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w} {h}] /Resources << /XObject << /I {n + 2} 0 R >> >> /Contents {n + 1} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n" % len(draw) + draw + b"\nendstream")
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n" % (iw, ih, len(data)) + data + b"\nendstream")
    out, at = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))
