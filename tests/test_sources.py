import zlib

import pytest

from sparkfolio.sources import env_number, page_budgets, read_baseline, read_documents
from sparkfolio.sources.pdf import pdf_text

CMAP = b"/CIDInit begincmap 2 beginbfchar <0001> <0041> <0002> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange endcmap"


def pdf(*pages, cmap=None, flate=True, packed=False):
    """A small PDF: one content stream a page, objects in an object stream where asked for."""
    body, objects = [], {}
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode()
    objects[3] = b"<< /Type /Font /Subtype /Type0" + (b" /ToUnicode 4 0 R" if cmap else b"") + b" >>"
    for i in range(len(pages)):
        objects[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {11 + 2 * i} 0 R >>".encode()
    streams = {11 + 2 * i: p for i, p in enumerate(pages)} | ({4: cmap} if cmap else {})
    if packed:
        head, data = b"", b""
        for n, o in objects.items():
            head += f"{n} {len(data)} ".encode()
            data += o + b" "
        z = zlib.compress(head + data)
        body.append(f"90 0 obj << /Type /ObjStm /N {len(objects)} /First {len(head)} /Filter /FlateDecode /Length {len(z)} >> stream\n".encode() + z + b"\nendstream endobj")
    else:
        body += [f"{n} 0 obj ".encode() + o + b" endobj" for n, o in objects.items()]
    for n, s in streams.items():
        z = zlib.compress(s) if flate else s
        body.append(f"{n} 0 obj << /Length {len(z)}{' /Filter /FlateDecode' if flate else ''} >> stream\n".encode() + z + b"\nendstream endobj")
    return b"%PDF-1.5\n" + b"\n".join(body) + b"\n%%EOF"


ONE = b"BT /F1 12 Tf 72 700 Td (Jan \\(Novak\\)) Tj 0 -14 Td [(Pro) -20 (ject) -400 (Lead)] TJ T* (caf\\351) Tj ET"


@pytest.mark.parametrize("flate", [True, False])
@pytest.mark.parametrize("packed", [True, False])
def test_pdf_text(flate, packed):
    assert pdf_text(pdf(ONE, b"BT (Second page) ' ET", flate=flate, packed=packed)) == "Jan (Novak)\nProject Lead\ncafé\nSecond page"


def test_pdf_fonts_and_broken_files():
    assert pdf_text(pdf(b"BT /F1 9 Tf <0001 0002> Tj <001000110012> Tj ET", cmap=CMAP)) == "Aéabc"
    assert pdf_text(pdf(b"q 100 0 0 100 0 0 cm /Im0 Do Q")) == ""
    assert pdf_text(b"") is None and pdf_text(b"%PDF-1.4 nothing") is None and pdf_text(b"plain") is None
    assert pdf_text(pdf(ONE).replace(b"%%EOF", b"trailer << /Encrypt 5 0 R >>")) is None
    broken = pdf(ONE)
    assert pdf_text(broken[: len(broken) // 2]) in (None, "")


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(ONE))
    (tmp_path / "b.pdf").write_bytes(pdf(b"q Q"))
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 nothing")
    got = {r.path[-5:]: (r.text and r.text[:11], r.problem) for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("Jan (Novak)", None), "b.pdf": ("", "no text layer"), "c.pdf": (None, "content doesn't fit the suffix"), "d.pdf": (None, "unreadable pdf")}


def test_baseline_and_settings(spark, tmp_path):
    (tmp_path / "b.json").write_text('["one", null, "two"]')
    (tmp_path / "c.json").write_text('{"x": 1}')
    assert read_baseline(spark, str(tmp_path / "b.json")) == ["one", "two"] and read_baseline(spark, str(tmp_path / "c.json")) == [] and read_baseline(spark, str(tmp_path / "none.json")) == []
    env = {"A": "7", "B": "x", "C": "900", "D": "-1", "E": "1.5"}
    assert [env_number(k, 5, 0, 100, env) for k in "ABCDF"] == [7, 5, 100, 0, 5] and env_number("E", 2.0, environ=env) == 1.5


def test_page_budgets(spark):
    rows = [(1, 1, 1, 20_000_000, 1, 1), (2, 1, 9, 1, 9_000_000, 1), (3, 1, 2, 1, 1, 30_000_000), (3, 2, 2, 1, 7_000_000, 30_000_000), (4, 1, 2, 1, 1, 30_000_000), (4, 2, 2, 1, 6_000_000, 30_000_000), (5, 1, 1, 10_000_000, 6_000_000, 48_000_000)]
    df = spark.createDataFrame(rows, "k int, page int, n_pages int, pdf_bytes long, pixels long, image_bytes long")
    assert {r.k: r.reason for r in page_budgets(df, "k").collect()} == {1: "pdf_bytes", 2: "too_many_pages", 3: "page_pixels", 4: "total_image_bytes", 5: None}
