"""Plain text as a PDF of numbered pages, without any library: one built-in font, characters outside Latin-1 as question marks."""

from __future__ import annotations

import textwrap

from pyspark.sql import SparkSession

from tessera.sources.files import folder

WIDTH, HEIGHT, MARGIN, SIZE, LEADING = 595, 842, 50, 9, 12


def pdf(text: str) -> bytes:
    """Lines are wrapped at 95 characters; lines that begin with # are set larger."""
    lines = [w for line in text.split("\n") for w in (textwrap.wrap(line, 95, drop_whitespace=False) or [""])]
    per_page = (HEIGHT - 2 * MARGIN) // LEADING - 2
    pages = [lines[k : k + per_page] for k in range(0, len(lines), per_page)]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for n, page in enumerate(pages, 1):
        out = [b"BT"]
        for k, line in enumerate([*page, "", f"{n} / {len(pages)}"]):
            shown = line.lstrip("#").strip() if line.startswith("#") else line
            raw = shown.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            out.append(b"/F1 %d Tf 1 0 0 1 %d %d Tm (%s) Tj" % (SIZE + 3 * line.startswith("#"), MARGIN, HEIGHT - MARGIN - LEADING * k, raw))
        body = b"\n".join([*out, b"ET"])
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    data, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(data))
        data += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return data + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(data))


def write_pdf(spark: SparkSession, text: str, path: str) -> None:
    """The text as one PDF file, replacing any at that path, in whatever file system the path names."""
    fs, at = folder(spark, path)
    stream = fs.create(at, True)
    stream.write(pdf(text))
    stream.close()
