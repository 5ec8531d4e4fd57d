"""PDFs made here object by object: trees, object streams, filters, fonts with maps of their own, and files that do harm."""

from __future__ import annotations

import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.kernels import attachments, mime, pdf


def stream(data: bytes, extra: bytes = b"", pack: bool = True) -> bytes:
    if pack:
        data, extra = zlib.compress(data), extra + b" /Filter /FlateDecode"
    return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" " + extra, data)


def document(objects: dict[int, bytes], root: int = 1, trailer: bytes = b"") -> bytes:
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return b"%PDF-1.7\n" + body + b"trailer\n<< /Root %d 0 R %s >>\nstartxref\n0\n%%%%EOF" % (root, trailer)


def pages(contents: list[bytes], font: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", more: dict[int, bytes] | None = None, resources: bytes = b"") -> bytes:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> %s >> >>" % (kids, len(contents), resources), 3: font}
    for i, c in enumerate(contents):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = stream(c)
    return document(objects | (more or {}))


def shows(text: bytes) -> bytes:
    return b"BT /F1 12 Tf 72 700 Td " + text + b" ET"


def test_pages_in_their_order():
    made = pages([shows(b"(second \\(page\\)) Tj 0 -14 Td (line two) Tj"), shows(b"[(spa) -20 (ced) -300 (words)] TJ T* (next) ' <48 69> Tj")])
    assert pdf.read(made) == "second (page)\nline two\nspaced words\nnextHi".replace("words\nnext", "words\nnext")
    swapped = made.replace(b"/Kids [10 0 R 12 0 R]", b"/Kids [12 0 R 10 0 R]")
    assert pdf.read(swapped).startswith("spaced words")


def test_a_font_with_its_own_map():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0047> <0002> <00FC0072> endbfchar 2 beginbfrange <0010> <0013> <0061> <0020> <0021> [<0030> <D83DDE00>] endbfrange"
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 4 0 R >>"
    made = pages([shows(b"<0001000200100011001300200021FFFF> Tj")], font, {4: stream(cmap)})
    assert pdf.read(made) == "Gürabd0😀"


def test_a_font_with_differences():
    font = b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /H /i /space 65 /uni20AC /adieresis /germandbls /nosuchglyph] >> >>"
    assert pdf.read(pages([shows(b"(\\001\\002\\003ABCxyz\\200) Tj")], font)) == "Hi €äßxyz€"
    mac = b"<< /Type /Font /Subtype /Type1 /Encoding /MacRomanEncoding >>"
    assert pdf.read(pages([shows(b"(\\212) Tj")], mac)) == "ä"


def test_object_streams_and_their_predictors():
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [5 0 R] /Count 1 >>", 5: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R /Resources << /Font << >> >> >>"}
    body, heads = b"", b""
    for n, o in inner.items():
        heads += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = stream(heads + body, b"/Type /ObjStm /N 3 /First %d" % len(heads))
    # a table of cross-references as a stream, its rows filtered upwards
    rows = bytes(range(40))
    up = b"".join(b"\x02" + bytes((rows[i + j] - (rows[i + j - 4] if i else 0)) & 255 for j in range(4)) for i in range(0, 40, 4))
    xref = stream(up, b"/Type /XRef /Root 1 0 R /W [1 2 1] /DecodeParms << /Predictor 12 /Columns 4 >>")
    made = b"%PDF-1.7\n7 0 obj\n" + packed + b"\nendobj\n6 0 obj\n" + stream(b"BT (from an object stream) Tj ET") + b"\nendobj\n8 0 obj\n" + xref + b"\nendobj\n"
    assert pdf.read(made) == "from an object stream"
    assert pdf.File(made).bytes_of(pdf.File(made).get(pdf.Ref(8))) == rows


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_rows_filtered_each_way(kind):
    rows, step = [bytes([7, 9, 200, 3, 1, 255]), bytes([8, 9, 100, 3, 250, 0])], 3
    out, above = b"", bytes(6)
    for r in rows:
        line = []
        for j, x in enumerate(r):
            a, b, c = (r[j - step], above[j], above[j - step]) if j >= step else (0, above[j], 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - (a, b, (a + b) // 2, paeth)[kind - 1]) & 255)
        out, above = out + bytes([kind, *line]), r
    assert pdf._predicted(out, {"Predictor": 15, "Colors": 3, "Columns": 2}) == b"".join(rows)


def test_other_filters():
    import base64

    text = shows(b"(packed twice) Tj")
    for name, data in ((b"/ASCIIHexDecode", text.hex().encode() + b">"), (b"/ASCII85Decode", base64.a85encode(text + b"\0\0\0\0x", adobe=False) + b"~>"), (b"/RunLengthDecode", bytes([len(text) - 1]) + text + bytes([254, 32, 128]))):
        made = pages([b""]).replace(stream(b""), b"<< /Length %d /Filter [%s] >>\nstream\n%s\nendstream" % (len(data), name, data))
        assert pdf.read(made) == "packed twice", name
    # the packing of the format's own example: codes of nine bits
    bits = "".join(f"{c:09b}" for c in (256, 45, 258, 258, 65, 259, 66, 257))
    assert pdf._lzw(int(bits.ljust(72, "0"), 2).to_bytes(9, "big"), 1) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_forms_and_pictures_within():
    form = stream(b"BT (in a form) Tj ET /Fm Do", b"/Type /XObject /Subtype /Form")
    made = pages([b"BT (before) Tj ET BI /W 1 /H 1 ID \x00(no) Tj\xff EI /Fm Do BT (after) Tj ET"], more={4: form}, resources=b"/XObject << /Fm 4 0 R >>")
    assert pdf.read(made).split("\n")[0] == "before" and "no" not in pdf.read(made).split("\n") and "in a form" in pdf.read(made)


def test_last_definition_counts_and_broken_tables_do_not():
    made = pages([shows(b"(old) Tj")]) + b"\n11 0 obj\n" + stream(shows(b"(new) Tj")) + b"\nendobj\n"
    assert pdf.read(made) == "new"
    assert pdf.read(b"junk before\n" + made.replace(b"startxref\n0", b"startxref\n999999")) == "new"
    cut = pages([shows(b"(" + b"long text " * 400 + b") Tj")])
    assert (pdf.read(cut[: cut.index(b"trailer")].replace(b"/Length", b"/Lenght")) or "").startswith("long text")


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.4 junk", document({1: b"<< /Pages 1 0 R >>"}), pages([shows(b"(x) Tj")]).replace(b"/Root", b"/Encrypt 9 0 R /Root"), pages([b""]), b"%PDF-1.4\n1 0 obj " + b"[" * 100_000, b"%PDF-" + b" " * (11 << 20)])
def test_nothing_to_be_had(data):
    assert pdf.read(data) is None


def test_trees_that_turn_back():
    made = document({1: b"<< /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R 3 0 R] >>", 3: b"<< /Kids [2 0 R] >>", 4: b"4 0 R"})
    assert pdf.read(made) is None


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 900))
def test_damage_is_never_an_error(junk, at):
    made = pages([shows(b"[(some) 3 (text)] TJ"), shows(b"(more) Tj")])
    at %= len(made)
    found = pdf.read(made[:at] + junk + made[at + len(junk) :])
    assert found is None or isinstance(found, str)


def test_bounds_from_outside():
    made = pages([shows(b"(fine) Tj")])
    assert pdf.text_of(made) == "fine" and pdf.text_of(pages([shows(b"(" + b"x" * 500 + b") Tj")]), most_out=100) == "x" * 100
    assert pdf.text_of(made, seconds=0) is None and pdf.text_of(b"no") is None
    slow = pages([b"q Q " * 2_000_000])
    began = time.monotonic()
    assert pdf.text_of(slow, seconds=0.5) is None and time.monotonic() - began < 3
    bomb = pages([b" " * (60 << 20) + shows(b"(x) Tj")])
    assert len(bomb) < 1 << 20 and pdf.text_of(bomb, seconds=5) is None
    large = pages([shows(b"(x) Tj ") + b" " * (30 << 20)])
    assert pdf.text_of(large) == "x" and pdf.text_of(large, memory=16 << 20) is None


def test_a_mail_with_pdfs():
    import base64

    def mail(data: bytes, n: int) -> bytes:
        part = b'--z\r\nContent-Type: application/pdf; name="a.pdf"\r\nContent-Disposition: attachment; filename="a.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\n' + base64.encodebytes(data) + b"\r\n"
        return b"From: a@b.example\r\nContent-Type: multipart/mixed; boundary=z\r\n\r\n" + part * n + b"--z--\r\n"

    made = pages([shows(b"(see http://x.example/a) Tj")])
    out = mime.sanitize(mime.raw_mail(mail(made, 2)))
    assert [(a["processed"], a["detected_kind"]) for a in out["attachments"]] == [(True, "pdf")] * 2 and "http" not in out["attachment_texts"][0]["text"]
    slow, began = pages([b"q Q " * 2_000_000]), time.monotonic()
    from postlake.limits import Limits

    out = mime.sanitize(mime.raw_mail(mail(slow, 6)), Limits(pdf_seconds=1.0))
    assert time.monotonic() - began < 6 and not any(a["processed"] for a in out["attachments"])
    plain = b"%PDF-1.4\n1 0 obj <<>> stream\n" + zlib.compress(b"BT (Hello) Tj ET") + b"\nendstream"
    assert pdf.text_of(plain) == attachments.extract_pdf_text(plain) == "Hello"
