"""Readers of archive formats: an index first, member bytes only on demand, by seeking."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

from ..functions.codec import plausible_script

# Magic numbers and limits of the formats.
XP3_MAGIC = bytes.fromhex("5850330d0a200a1a8b6701")
ARC_KINDS = {b"PackFile    ": (16, 8), b"BURIKO ARC20": (96, 24)}
MAX_MEMBER, MAX_INDEX, MAX_BLOCKS, MAX_ENTRIES = 64 << 20, 64 << 20, 8, 1 << 20


@dataclass(frozen=True)
class Member:
    name: str
    size: int
    read: Callable[[], bytes]


def _exact(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"{n} bytes wanted at {at}, {len(data)} there")
    return data


def xp3_base(f: BinaryIO) -> int:
    """Where an XP3 starts: at 0, or aligned to 16 bytes inside an executable; -1 if nowhere."""
    head = f.read(11) if f.seek(0) == 0 else b""
    if head == XP3_MAGIC:
        return 0
    if head[:2] != b"MZ":
        return -1
    f.seek(0)
    data = f.read(MAX_MEMBER)
    at = data.find(XP3_MAGIC)
    while at >= 0 and at % 16:
        at = data.find(XP3_MAGIC, at + 1)
    return at


def _xp3_blocks(f: BinaryIO, base: int) -> Iterator[bytes]:
    at, seen = struct.unpack("<Q", _exact(f, base + 11, 8))[0], set()
    for _ in range(MAX_BLOCKS):
        if at in seen:
            return
        seen.add(at)
        flag = _exact(f, base + at, 1)[0]
        size = struct.unpack("<Q", _exact(f, base + at + 1, 8))[0]
        if flag & 7 == 1:
            if size > MAX_INDEX:
                raise ValueError("index too large")
            yield zlib.decompress(_exact(f, base + at + 17, size))
            end = at + 17 + size
        elif flag & 0x80 and (size == 0 or size > MAX_INDEX):
            end = at + 9
        else:
            if size > MAX_INDEX:
                raise ValueError("index too large")
            yield _exact(f, base + at + 9, size)
            end = at + 9 + size
        if not flag & 0x80:
            return
        at = struct.unpack("<Q", _exact(f, base + end, 8))[0]


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at + 12 <= len(data):
        size = struct.unpack_from("<Q", data, at + 4)[0]
        if at + 12 + size > len(data):
            return
        yield data[at : at + 4], data[at + 12 : at + 12 + size]
        at += 12 + size


def xp3_members(f: BinaryIO, wanted: Callable[[str], bool] = lambda name: True) -> Iterator[Member]:
    base = xp3_base(f)
    if base < 0:
        raise ValueError("not an XP3 archive")
    renamed = None
    for block in _xp3_blocks(f, base):
        for tag, body in _chunks(block):
            if tag == b"eliF" and len(body) >= 6:
                renamed = body[6 : 6 + 2 * struct.unpack_from("<H", body, 4)[0]].decode("utf-16-le", "replace").rstrip("\0")
            if tag != b"File":
                continue
            info, segments, key = None, [], 0
            for part, data in _chunks(body):
                if part == b"info" and info is None and len(data) >= 22:
                    flags, size = struct.unpack_from("<IQ", data)
                    info = (flags, size, data[22 : 22 + 2 * struct.unpack_from("<H", data, 20)[0]].decode("utf-16-le", "replace").rstrip("\0"))
                elif part == b"segm":
                    segments += [struct.unpack_from("<IQQQ", data, i) for i in range(0, len(data) - 27, 28)]
                elif part == b"adlr" and len(data) >= 4:
                    key = struct.unpack_from("<I", data)[0]
            if info is None or not segments:
                continue
            flags, size, name = info
            protected = bool(flags >> 31)
            if protected and renamed:
                name, renamed = renamed, None
            name = name.replace("\\", "/")
            if wanted(name) and size <= MAX_MEMBER:
                yield Member(name, size, lambda s=segments, p=protected, k=key, n=size: _xp3_read(f, base, s, n, p, k))


def _xp3_read(f: BinaryIO, base: int, segments: list, size: int, protected: bool, key: int) -> bytes:
    parts = []
    for flags, start, org, packed in segments:
        raw = _exact(f, base + start, packed)
        if flags & 7:
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                if org != packed:
                    raise
        parts.append(raw)
    data = b"".join(parts)
    if protected:
        plain = data.translate(bytes(b ^ key & 0xFF for b in range(256)))
        if zlib.adler32(plain) != key and not plausible_script(plain):
            raise ValueError("protected member")
        data = plain
    return data[:size]


def _name(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("cp932", "replace").replace("\\", "/")


def _cstr(f: BinaryIO, at: int) -> tuple[str, int]:
    f.seek(at)
    raw = f.read(1024)
    end = raw.find(b"\0")
    if end < 0:
        raise ValueError("name without an end")
    return raw[:end].decode("cp932", "replace").replace("\\", "/"), at + end + 1


def sar_members(f: BinaryIO) -> Iterator[Member]:
    count, base = struct.unpack(">HI", _exact(f, 0, 6))
    at = 6
    for _ in range(count):
        name, at = _cstr(f, at)
        offset, size = struct.unpack(">II", _exact(f, at, 8))
        at += 8
        if size <= MAX_MEMBER:
            yield Member(name, size, lambda o=base + offset, n=size: _exact(f, o, n))


def _nsa_index(f: BinaryIO, start: int, length: int) -> list[tuple]:
    count, delta = struct.unpack(">HI", _exact(f, start, 6))
    at, out = start + 6, []
    for _ in range(count):
        name, at = _cstr(f, at)
        method, offset, packed, size = struct.unpack(">BIII", _exact(f, at, 13))
        at += 13
        if not name or start + delta + offset + packed > length:
            raise ValueError("no NSA index here")
        out.append((name, method, start + delta + offset, packed, size))
    return out


def nsa_members(f: BinaryIO) -> Iterator[Member]:
    """The index starts at 0 or at 2; the first place that gives entries counts."""
    length = f.seek(0, io.SEEK_END)
    entries: list[tuple] = []
    for start in (0, 2):
        try:
            entries = _nsa_index(f, start, length)
        except (ValueError, struct.error):
            continue
        if entries:
            break
    for name, method, offset, packed, size in entries:
        if method in (0, 2) and size <= MAX_MEMBER:
            read = (lambda o=offset, n=packed: _exact(f, o, n)) if method == 0 else (lambda o=offset, n=packed, s=size: lzss(_exact(f, o, n), s))
            yield Member(name, size, read)


def lzss(data: bytes, size: int) -> bytes:
    """Bits from the top: 1 and a literal byte, or 0, an 8-bit window place and a 4-bit length - 2; window 256, first write at 239."""
    window, write, out = bytearray(256), 239, bytearray()
    bits, have, at = 0, 0, 0

    def take(n: int) -> int:
        nonlocal bits, have, at
        while have < n:
            if at >= len(data):
                raise EOFError
            bits, have, at = (bits << 8 | data[at]) & 0xFFFFFF, have + 8, at + 1
        have -= n
        return bits >> have & (1 << n) - 1

    try:
        while len(out) < size:
            if take(1):
                run = (take(8),)
            else:
                place, run = take(8), range(take(4) + 2)
                run = ((place, k) for k in run)
            for x in run:
                byte = x if isinstance(x, int) else window[x[0] + x[1] & 0xFF]
                out.append(byte)
                window[write] = byte
                write = write + 1 & 0xFF
    except EOFError:
        pass
    return bytes(out[:size])


def arc_members(f: BinaryIO) -> Iterator[Member]:
    length = f.seek(0, io.SEEK_END)
    head = _exact(f, 0, 16)
    if head[:12] not in ARC_KINDS:
        raise ValueError("not an ARC archive")
    width, skip = ARC_KINDS[head[:12]]
    count = struct.unpack_from("<I", head, 12)[0]
    record = width + 8 + skip
    if not 1 <= count <= MAX_ENTRIES or 16 + count * record > length:
        raise ValueError("index out of range")
    index = _exact(f, 16, count * record)
    for i in range(count):
        row = index[i * record : (i + 1) * record]
        offset, size = struct.unpack_from("<II", row, width)
        start = 16 + count * record + offset
        if row[:1] != b"\0" and start + size <= length and size <= MAX_MEMBER:
            yield Member(_name(row[:width]), size, lambda o=start, n=size: _exact(f, o, n))


READERS = {".xp3": xp3_members, ".exe": xp3_members, ".nsa": nsa_members, ".sar": sar_members, ".arc": arc_members}
