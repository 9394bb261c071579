"""PDF pages: what the writer makes, what other writers make, and damaged files."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lipika.sources import files, pdf

call = pdf.extractor()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\r"), max_size=60), max_size=4))
def test_round_trip(pages):
    assert call(pdf.ascii_pdf(pages).encode("ascii")) == pages


def by_hand(content, more=b"", font=b"<< /Type /Font /Subtype /Type1 >>", compress=False):
    body = zlib.compress(content) if compress else content
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
        b"3 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents [4 0 R] >> endobj\n"
        b"4 0 obj << /Length 6 0 R " + (b"/Filter /FlateDecode " if compress else b"") + b">>\nstream\r\n" + body + b"\nendstream endobj\n"
        b"5 0 obj " + font + b" endobj\n" + more + b"\ntrailer << /Root 1 0 R >>\n"
    )


def test_operators_strings_and_kerning():
    content = rb"BT /F1 12 Tf 72 700 Td (One \(nested (deep)\) \101\102) Tj 0 -14 Td [(Ke) -30 (rned) -400 (words)] TJ T* (third) Tj (fourth) ' 1 0 0 1 72 500 Tm <66696674 68> Tj ET % end"
    want = ["One (nested (deep)) AB\nKerned words\nthird\nfourth\nfifth"]
    assert call(by_hand(content)) == want and call(by_hand(content, compress=True)) == want
    assert call(by_hand(b"BT /F1 9 Tf (caf\\351) Tj ET")) == ["café"]


def test_object_streams_and_later_versions():
    inner = b"5 0 7 20 << /Type /Font >> << /Kind /Other >>"
    packed = b"9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length 99 >> stream\n" + zlib.compress(inner) + b"\nendstream endobj\n"
    assert call(by_hand(b"BT /F1 9 Tf (x) Tj ET", packed)) == ["x"]
    newer = b"4 0 obj << /Length 25 >> stream\nBT /F1 9 Tf (newer) Tj ET  \nendstream endobj\n"
    assert call(by_hand(b"BT /F1 9 Tf (older) Tj ET", newer)) == ["newer"]


@pytest.mark.parametrize("data", [b"", b"no pdf at all", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj", b"%PDF-1.4\ntrailer << /Root 1 0 R /Encrypt 2 0 R >>", by_hand(b"BT (open"), by_hand(b"x").replace(b"/Kids [3 0 R]", b"/Kids [2 0 R]"), by_hand(b"x", compress=True).replace(b"FlateDecode", b"LZWDecode")])
def test_damaged_files_raise(data):
    with pytest.raises(Exception):
        call(data)


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_text(pdf.ascii_pdf(["page one\n\n\n\nend  ", "", "धर्मः"]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.txt").write_text("text")
    got = {r.filename: r for r in files.directory_documents(spark, f"file://{tmp_path}").collect()}
    assert got["a.pdf"].status == "ok" and got["a.pdf"].text == "page one\n\nend\n\nधर्मः"
    assert got["b.pdf"].status == "failed" and got["b.pdf"].error and got["c.txt"].text == "text"
    assert files.directory_documents(spark, f"file://{tmp_path}", None).where(F.col("filename") == "a.pdf").first().error == "no extractor"
