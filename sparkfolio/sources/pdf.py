"""The text layer of PDF files, read with the standard library.

Objects are found by their headers, also inside object streams; streams are plain or Flate-coded.  Each page's
content is run through the operators that place text; strings become characters by the font's ToUnicode map,
else as Latin-1.  Encrypted files, other stream filters and pages that are images give no text.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?=\bendobj\b|\d+\s+\d+\s+obj\b|\Z)", re.S)
_STREAM = re.compile(rb"^(.*?)stream\r?\n(.*)", re.S)
_REF = rb"(\d+)\s+\d+\s+R"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.0-9]+|[A-Za-z'\"*]+", re.S)
#: A kern of so many thousandths of the font's size is a blank.
WORD_GAP = 180


def _inflate(data: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return b""


def _objects(raw: bytes) -> dict[int, bytes]:
    found: dict[int, bytes] = {}
    for m in _OBJECT.finditer(raw):
        found[int(m[1])] = m[2]
    for body in list(found.values()):
        if b"/ObjStm" in body and (s := _stream(body)) and (first := re.search(rb"/First\s+(\d+)", body)):
            head = [int(x) for x in s[: int(first[1])].split()]
            places = list(zip(head[::2], head[1::2]))
            for (number, at), (_, end) in zip(places, places[1:] + [(0, len(s) - int(first[1]))]):
                found.setdefault(number, s[int(first[1]) + at: int(first[1]) + end])
    return found


def _stream(body: bytes) -> bytes | None:
    m = _STREAM.match(body)
    if not m:
        return None
    data = m[2][: m[2].rfind(b"endstream")] if b"endstream" in m[2] else m[2]
    if b"/FlateDecode" in m[1]:
        return _inflate(data)
    return data if b"/Filter" not in m[1] else b""


def _refs(objects: dict[int, bytes], body: bytes, key: bytes) -> list[int]:
    """Object numbers that a key of a dictionary refers to, one or an array."""
    m = re.search(rb"/" + key + rb"\s*(?:\[([^\]]*)\]|" + _REF + rb")", body)
    if not m:
        return []
    if m[1] is not None:
        return [int(x) for x in re.findall(_REF, m[1])]
    target = objects.get(int(m[2]), b"").strip()
    return [int(x) for x in re.findall(_REF, target)] if target.startswith(b"[") else [int(m[2])]


def _unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, code -> characters) of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    size, out = 1, {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            size = max(size, len(code) // 2)
            out[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            size = max(size, len(low) // 2)
            each = re.findall(rb"<([0-9A-Fa-f]+)>", several)
            for i in range(min(int(high, 16) - int(low, 16) + 1, 65536)):
                if each:
                    out[int(low, 16) + i] = text(each[i]) if i < len(each) else ""
                else:
                    start = text(to)
                    out[int(low, 16) + i] = start[:-1] + chr(ord(start[-1]) + i)
    return size, out


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        h = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    escape = lambda m: _ESCAPES.get(m[1], bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escape, token[1:-1], flags=re.S)


def _page_text(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    out, args, font = [], [], (1, {})

    def show(token: bytes) -> None:
        size, table = font
        data = _string(token)
        if not table:
            out.append(data.decode("latin-1"))
            return
        out.append("".join(table.get(int.from_bytes(data[i: i + size], "big"), "") for i in range(0, len(data), size)))

    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/" or t[:1] in b"-+.0123456789":
            args.append(t)
            continue
        if t == b"Tf":
            font = next((fonts[a[1:]] for a in args if a[1:] in fonts and a.startswith(b"/")), (1, {}))
        elif t in (b"T*", b"'", b'"', b"ET", b"Td", b"TD", b"Tm"):
            moved = t in (b"Td", b"TD") and len(args) >= 2 and float(args[-1] or 0) == 0
            out.append(" " if moved else "\n")
        if t in (b"Tj", b"'", b'"', b"TJ"):
            for a in args:
                if a[:1] in b"(<":
                    show(a)
                elif t == b"TJ" and a[:1] == b"-" and re.fullmatch(rb"-[\d.]+", a) and float(a) <= -WORD_GAP:
                    out.append(" ")
        args = []
    text = re.sub(r"[ \t]*\n\s*", "\n", "".join(out))
    return re.sub(r" {2,}", " ", text).strip()


def pdf_text(content: bytes) -> str | None:
    """The pages' texts in order, one after another; None for a file that isn't a readable PDF, '' without a text layer."""
    if b"%PDF" not in content[:1024] or b"/Encrypt" in content:
        return None
    objects = _objects(content)
    kids = [n for b in objects.values() if re.search(rb"/Type\s*/Pages\b", b) for n in _refs(objects, b, b"Kids")]
    pages = [n for n in kids if re.search(rb"/Type\s*/Page\b", objects.get(n, b""))]
    pages += [n for n, b in sorted(objects.items()) if n not in pages and re.search(rb"/Type\s*/Page\b", b)]
    texts = []
    for n in pages:
        body = objects[n]
        where = body
        for r in _refs(objects, body, b"Resources"):
            where += objects.get(r, b"")
        for r in _refs(objects, where, b"Font"):
            where += objects.get(r, b"")
        fonts = {}
        for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+" + _REF, where):
            for u in _refs(objects, objects.get(int(ref), b""), b"ToUnicode"):
                fonts[name] = _unicode_map(_stream(objects.get(u, b"")) or b"")
        content_of = b"\n".join(_stream(objects.get(c, b"")) or b"" for c in _refs(objects, body, b"Contents"))
        texts.append(_page_text(content_of, fonts))
    return "\n".join(t for t in texts if t) if pages else None
