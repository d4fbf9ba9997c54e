"""The information dictionary of a PDF, from its bytes: cross-reference tables and streams, object streams, all kinds of strings.

Only what leads to the dictionary is read: the chain of cross-references from the file's end,
newest first, and the one object that the trailer names.
"""

from __future__ import annotations

import re
import zlib

_SPACE = b"\0\t\n\f\r "
_END = _SPACE + b"()<>[]{}/%"
_ESCAPES = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
#: Bytes that a stream may inflate to, and levels that values may nest to; beyond, the dictionary counts as unreadable.
INFLATED, DEPTH = 64 << 20, 32


class Unreadable(ValueError):
    """The file is damaged, or written in a way that is not read here."""


class Ref(tuple):
    """A reference to an object: its number and generation."""


def _skip(data: bytes, at: int) -> int:
    while at < len(data):
        if data[at] in _SPACE:
            at += 1
        elif data[at] == 37:  # a comment
            while at < len(data) and data[at] not in b"\r\n":
                at += 1
        else:
            break
    return at


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses, which may nest, from behind the first one."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 92 and at < len(data):
            c = data[at]
            at += 1
            if 48 <= c <= 55:
                end = at
                while end < at + 2 and end < len(data) and 48 <= data[end] <= 55:
                    end += 1
                out.append(int(data[at - 1 : end], 8) & 255)
                at = end
            elif c == 13:
                at += data[at : at + 1] == b"\n"
            elif c != 10:
                out.append(_ESCAPES.get(c, c))
            continue
        depth += (c == 40) - (c == 41)
        if not depth:
            return bytes(out), at
        out.append(c)
    raise Unreadable("a string has no end")


def value(data: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    """The value at a place, and where it ends: dict, list, bytes, Ref, number, name or word (str)."""
    at = _skip(data, at)
    if at >= len(data) or depth > DEPTH:
        raise Unreadable("a value is missing or nests too deep")
    if data.startswith(b"<<", at):
        out, at = {}, _skip(data, at + 2)
        while not data.startswith(b">>", at):
            key, at = value(data, at, depth + 1)
            if not isinstance(key, str) or not key.startswith("/"):
                raise Unreadable("a dictionary without names")
            out[key], at = value(data, at, depth + 1)
            at = _skip(data, at)
        return out, at + 2
    c = data[at]
    if c == 60:
        end = data.find(b">", at)
        digits = bytes(x for x in data[at + 1 : max(end, at)] if x not in _SPACE)
        if end < 0 or re.search(rb"[^0-9A-Fa-f]", digits):
            raise Unreadable("a hexadecimal string is damaged")
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if c == 40:
        return _literal(data, at + 1)
    if c == 91:
        items, at = [], _skip(data, at + 1)
        while data[at : at + 1] != b"]":
            item, at = value(data, at, depth + 1)
            items.append(item)
            at = _skip(data, at)
        return items, at + 1
    end = at + 1
    while end < len(data) and data[end] not in _END:
        end += 1
    word = data[at:end].decode("latin-1")
    if word.isdigit() and (m := re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![A-Za-z0-9])").match(data, end)):
        return Ref((int(word), int(m[1]))), m.end()
    return (int(word) if re.fullmatch(r"[+-]?\d+", word) else word), end


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Rows of PNG's filters Sub and Up undone, as cross-reference streams use them."""
    out, above = bytearray(), bytearray(columns)
    for at in range(0, len(data) - columns, columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        if kind == 1:
            for i in range(1, columns):
                row[i] = (row[i] + row[i - 1]) & 255
        elif kind == 2:
            row = bytearray((a + b) & 255 for a, b in zip(row, above, strict=True))
        elif kind:
            raise Unreadable("a predictor that is not read")
        out += row
        above = row
    return bytes(out)


def _stream(data: bytes, facts: dict, at: int) -> bytes:
    """The decoded bytes of a stream whose dictionary ends at a place."""
    m = re.compile(rb"[\0\t\n\f\r ]*stream\r?\n").match(data, at)
    if not m:
        raise Unreadable("a stream is missing")
    size = facts.get("/Length")
    end = m.end() + size if isinstance(size, int) else data.find(b"endstream", m.end())
    raw, filters = data[m.end() : end], facts.get("/Filter", [])
    for f in filters if isinstance(filters, list) else [filters]:
        if f != "/FlateDecode":
            raise Unreadable(f"the filter {f} is not read")
        try:
            raw = zlib.decompressobj().decompress(raw, INFLATED)
        except zlib.error as e:
            raise Unreadable("a stream is damaged") from e
    parms = facts.get("/DecodeParms") or {}
    parms = parms[0] if isinstance(parms, list) else parms
    return _unpredicted(raw, parms.get("/Columns", 1)) if isinstance(parms, dict) and parms.get("/Predictor", 1) > 1 else raw


def _object(data: bytes, at: int) -> tuple[object, int]:
    m = re.compile(rb"[\0\t\n\f\r ]*\d+[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+obj").match(data, at)
    if not m:
        raise Unreadable("no object where one should be")
    return value(data, m.end())


def _sections(data: bytes) -> tuple[dict, dict[int, tuple]]:
    """The trailer's facts and the place of each object, newest first along the chain."""
    tail = data.rfind(b"startxref")
    m = re.compile(rb"startxref\s+(\d+)").match(data, max(tail, 0))
    if not m:
        raise Unreadable("no startxref")
    facts: dict = {}
    places: dict[int, tuple] = {}
    todo, seen = [int(m[1])], set()
    while todo:
        at = todo.pop(0)
        if at in seen:
            continue
        if at >= len(data):
            raise Unreadable("a cross-reference beyond the file's end")
        seen.add(at)
        at = _skip(data, at)
        if data.startswith(b"xref", at):
            at += 4
            while m := re.compile(rb"\s*(\d+)\s+(\d+)[ \t]*\r?\n?").match(data, at):
                first, n, at = int(m[1]), int(m[2]), m.end()
                for k, e in enumerate(re.finditer(rb"\s*(\d{10}) (\d{5}) ([nf])", data[at : at + 20 * n])):
                    if e[3] == b"n":
                        places.setdefault(first + k, (1, int(e[1])))
                at += 20 * n
                at = data.rfind(b"\n", 0, at) + 1 if not re.compile(rb"\s*(\d|trailer)").match(data, at) else at
            m = re.compile(rb"\s*trailer").match(data, at)
            if not m:
                raise Unreadable("no trailer")
            own, _ = value(data, m.end())
        else:
            own, end = _object(data, at)
            if not isinstance(own, dict) or own.get("/Type") != "/XRef":
                raise Unreadable("no cross-reference where one should be")
            table, widths = _stream(data, own, end), own["/W"]
            index = own.get("/Index") or [0, own.get("/Size", 0)]
            at, step = 0, sum(widths)
            for first, n in zip(index[::2], index[1::2], strict=True):
                for k in range(n):
                    cells, left = [], at
                    for w in widths:
                        cells.append(int.from_bytes(table[left : left + w], "big") if w else 1)
                        left += w
                    at += step
                    if cells[0] in (1, 2):
                        places.setdefault(first + k, tuple(cells))
        if not isinstance(own, dict):
            raise Unreadable("the trailer is no dictionary")
        for k, v in own.items():
            facts.setdefault(k, v)
        todo += [own[k] for k in ("/XRefStm", "/Prev") if isinstance(own.get(k), int)]
    return facts, places


def _resolved(data: bytes, ref: object, places: dict[int, tuple]) -> object:
    if not isinstance(ref, Ref):
        return ref
    place = places.get(ref[0])
    if place is None:
        return None
    if place[0] == 1:
        return _object(data, place[1])[0]
    holder = places.get(place[1])
    if not holder or holder[0] != 1:
        raise Unreadable("an object stream is missing")
    facts, end = _object(data, holder[1])
    body = _stream(data, facts, end)
    numbers = [int(x) for x in body[: facts["/First"]].split()]
    for n, at in zip(numbers[::2], numbers[1::2], strict=False):
        if n == ref[0]:
            return value(body, facts["/First"] + at)[0]
    return None


def text(raw: bytes) -> str:
    """A text string: UTF-16 or UTF-8 behind its mark, else a byte for a character."""
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    return raw[3:].decode("utf-8", "replace") if raw.startswith(b"\xef\xbb\xbf") else raw.decode("latin-1")


def information(data: bytes) -> dict[str, str] | None:
    """The text entries of the information dictionary by name; none if there is no such dictionary, null if it can't be read.

    It can't be read in encrypted files, in damaged ones, and where filters stand in the way.
    """
    try:
        facts, places = _sections(data)
        if "/Encrypt" in facts:
            return None
        found = _resolved(data, facts.get("/Info"), places)
        if found is None:
            return None if "/Info" in facts else {}
        if not isinstance(found, dict):
            return None
        entries = {k[1:]: _resolved(data, v, places) for k, v in found.items()}
        return {k: text(v) for k, v in entries.items() if isinstance(v, bytes)}
    except (Unreadable, KeyError, TypeError, ValueError, IndexError, RecursionError):
        return None
