"""The text layer of PDF files, page by page, in plain Python: no rendering, no guesses.

Objects are found by scanning, object streams and deflated streams are opened, pages follow the page tree. Text comes
from the text-showing operators of simple fonts (with ToUnicode maps where a font has one); a new line begins where the text
position moves down. Encrypted files and other stream filters are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from .formats import Refused, _block

#: Pages of a file, and bytes that a stream may grow to when it is opened.
MAX_PAGES, MAX_STREAM = 10_000, 256 << 20
_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(
    rb"(?P<space>[\x00\t\n\x0c\r ]+|%[^\r\n]*)|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<string>\()|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<ref>\d+\s+\d+\s+R\b)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[A-Za-z'\"*][A-Za-z0-9'\"*]*)|(?P<other>.)",
    re.S,
)


class Name(str):
    """A PDF name, without its slash."""


class Ref(tuple):
    """The number of an indirect object."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string that opens before `at`, and where it ends."""
    out, depth = bytearray(), 1
    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            c = data[at : at + 1]
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            else:
                at += 2 if data[at : at + 2] == b"\r\n" else 1
                out += b"" if c in (b"\n", b"\r") else escapes.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at
        out += c
    raise Refused("pdf-string")


def tokens(data: bytes, at: int = 0):
    """Values and operators from `at` on; containers come as lists and dicts, operators as ('op', name)."""
    stack: list[list] = []
    while at < len(data):
        m = _TOKEN.match(data, at)
        at, kind, raw = m.end(), m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind == "open":
            stack.append([raw])
            continue
        if kind == "close":
            if not stack:
                return
            opened, *items = stack.pop()
            value = {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)} if opened == b"<<" else items
        elif kind == "string":
            value, at = _string(data, at)
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", raw[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "name":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw[1:]).decode("latin-1"))
        elif kind == "ref":
            value = Ref((int(raw.split()[0]),))
        elif kind == "number":
            value = float(raw)
        elif kind == "word":
            word = raw.decode("latin-1")
            if word in ("endobj", "stream", "ID") and not stack:
                yield "op", word, at
                return
            value = {"true": True, "false": False, "null": None}.get(word, ("op", word))
        else:
            continue
        if stack:
            stack[-1].append(value)
        else:
            yield ("op", value[1], at) if isinstance(value, tuple) and not isinstance(value, Ref) and value[:1] == ("op",) else ("value", value, at)


class _File:
    def __init__(self, data: bytes):
        self.data, self.objects, self.streams = data, {}, {}
        for m in _OBJECT.finditer(data):
            found = list(tokens(data, m.end()))
            if not found or found[0][0] != "value":
                continue
            number = int(m[1])
            self.objects[number] = found[0][1]
            if len(found) > 1 and found[1][:2] == ("op", "stream"):
                self.streams[number] = found[1][2]
        for number in [n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "ObjStm"]:
            self._unpack(number)

    def get(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 32:
            value, seen = self.objects.get(value[0]), seen + 1
        return value

    def content(self, number: int) -> bytes:
        """The opened stream of an object."""
        head, at = self.objects[number], self.streams[number]
        at += 2 if self.data[at : at + 2] == b"\r\n" else 1
        length = self.get(head.get("Length"))
        end = at + int(length) if isinstance(length, float) else self.data.find(b"endstream", at)
        raw = self.data[at:end]
        filters = self.get(head.get("Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(name) != "FlateDecode":
                raise Refused(f"pdf-filter:{name}")
            try:
                opened = zlib.decompressobj()
                raw = opened.decompress(raw, MAX_STREAM)
            except zlib.error as e:
                raise Refused("pdf-stream") from e
            if opened.unconsumed_tail:
                raise Refused("pdf-stream-limit")
        return raw

    def _unpack(self, number: int) -> None:
        head = self.objects[number]
        raw = self.content(number)
        first, count = int(self.get(head["First"])), int(self.get(head["N"]))
        numbers = [int(x) for x in raw[:first].split()[: 2 * count]]
        for n, at in zip(numbers[::2], numbers[1::2]):
            value = next(iter(tokens(raw, first + at)), None)
            if value and value[0] == "value":
                self.objects.setdefault(n, value[1])

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        roots = [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"]
        if not roots:
            raise Refused("pdf-no-catalog")
        out, stack, seen = [], [(roots[-1].get("Pages"), {})], set()
        while stack:
            ref, above = stack.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            whole = above | node
            if "Kids" in node:
                stack.extend((kid, {k: v for k, v in whole.items() if k == "Resources"}) for kid in reversed(self.get(node["Kids"]) or []))
            else:
                out.append(whole)
            if len(out) > MAX_PAGES:
                raise Refused("pdf-page-limit")
        return out

    def unicode_map(self, font: dict) -> dict[bytes, str]:
        """Codes of a font -> text, from its ToUnicode map; empty without one."""
        ref = font.get("ToUnicode")
        if not isinstance(ref, Ref) or ref[0] not in self.streams:
            return {}
        out, values = {}, []
        text = lambda b: b.decode("utf-16-be", "replace")
        for kind, value, _ in tokens(self.content(ref[0])):
            if kind == "value":
                values.append(value)
                continue
            if value == "endbfchar":
                out |= {a: text(b) for a, b in zip(values[::2], values[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif value == "endbfrange":
                for low, high, to in zip(values[::3], values[1::3], values[2::3]):
                    for k in range(int.from_bytes(low, "big"), min(int.from_bytes(high, "big"), int.from_bytes(low, "big") + 65535) + 1):
                        step = k - int.from_bytes(low, "big")
                        code = k.to_bytes(len(low), "big")
                        out[code] = text(to[step]) if isinstance(to, list) else text((int.from_bytes(to, "big") + step).to_bytes(len(to), "big"))
            values = []
        return out


def _shown(raw: bytes, codes: dict[bytes, str]) -> str:
    if not codes:
        return raw.decode("cp1252", "replace")
    width = max(map(len, codes))
    parts = [raw[k : k + width] for k in range(0, len(raw), width)]
    return "".join(codes.get(p, "") for p in parts)


def page_text(file: _File, page: dict) -> str:
    """The text of a page, lines where the position moves down."""
    contents = page.get("Contents")
    parts = contents if isinstance(file.get(contents), dict) or isinstance(contents, list) else file.get(contents)
    refs = parts if isinstance(parts, list) else [contents]
    data = b"\n".join(file.content(r[0]) for r in refs if isinstance(r, Ref) and r[0] in file.streams)
    fonts = file.get((file.get(page.get("Resources")) or {}).get("Font")) or {}
    maps: dict[str, dict[bytes, str]] = {}
    out, args, codes, y, leading = [], [], {}, None, 0.0

    def moved(to: float) -> None:
        nonlocal y
        if y is not None and abs(to - y) > 0.1 and out and not out[-1].endswith("\n"):
            out.append("\n" if abs(to - y) < 2.2 * max(leading, 8) else "\n\n")
        y = to

    for kind, value, _ in tokens(data):
        if kind == "value":
            args.append(value)
            continue
        numbers = [a for a in args if isinstance(a, float)]
        if value == "Tf" and args and isinstance(args[0], Name):
            name = str(args[0])
            if name not in maps:
                maps[name] = file.unicode_map(file.get(fonts.get(name)) or {})
            codes, leading = maps[name], max(leading, abs(numbers[-1]) if numbers else 0.0)
        elif value in ("Td", "TD") and len(numbers) >= 2:
            moved((y or 0.0) + numbers[1])
        elif value == "Tm" and len(numbers) >= 6:
            moved(numbers[5])
        elif value in ("T*", "'", '"'):
            moved((y or 0.0) - max(leading, 1.0))
        elif value == "BT":
            y = 0.0 if y is None else y
        if value in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            out.append(_shown(args[-1], codes))
        elif value == "TJ" and args and isinstance(args[-1], list):
            for part in args[-1]:
                out.append(_shown(part, codes) if isinstance(part, bytes) else " " if isinstance(part, float) and part < -200 else "")
        args = []
    return "".join(out).replace("\r\n", "\n").replace("\r", "\n").strip("\n")


def page_texts(data: bytes) -> list[str]:
    """The text of each page; a page without a text layer is empty."""
    if not data.lstrip()[:5].startswith(b"%PDF-"):
        raise Refused("not-a-pdf")
    file = _File(data)
    if any(isinstance(o, dict) and o.get("Type") == "Catalog" for o in file.objects.values()) and b"/Encrypt" in data:
        raise Refused("pdf-encrypted")
    return [page_text(file, page) for page in file.pages()]


#: (page number from 1, bytes of the file) -> text, or None if it has none.
Recogniser = Callable[[int, bytes], str | None]


def recovered(texts: list[str], data: bytes, recognise: Recogniser | None) -> list[str]:
    """Texts of pages, those without a text layer from the recogniser; text of the file itself is never replaced."""
    if recognise is None:
        return texts
    return [t if t.strip() else recognise(k, data) or "" for k, t in enumerate(texts, 1)]


def parse_pdf(data: bytes, recognise: Recogniser | None = None) -> list[dict]:
    """Paragraphs between blank lines, each with its page. A page without text is an error unless a recogniser reads it."""
    texts = recovered(page_texts(data), data, recognise)
    if any(not t.strip() for t in texts):
        raise Refused("pdf-ocr-required")
    return [{**_block("paragraph", p.strip()), "page": k} for k, text in enumerate(texts, 1) for p in re.split(r"\n\s*\n", text) if p.strip()]
