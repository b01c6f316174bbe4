"""DSC: compressed BGI scripts, a Huffman code over literals and back references.

Layout (little-endian): 16 bytes of magic, key, unpacked size and number of codes as 32-bit
integers, 4 unused bytes; from byte 32 on the code lengths of 512 symbols, each one byte plus
a byte of the key stream; then bits from the top. Codes are canonical: at every depth the
leaves come first, in order of their symbols. A symbol below 256 is a byte; another one
stands for a copy of (symbol - 256) + 2 bytes, and 12 more bits, plus 2, say from how far back.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DSC FORMAT 1.00\0"
HEADER, SYMBOLS = 32, 512
#: Largest unpacked size.
MAX_SIZE = 64 << 20


def key_stream(key: int, n: int) -> bytes:
    """n bytes of the stream that hides the code lengths; its constant is the magic's first two bytes."""
    high = int.from_bytes(MAGIC[:2], "little") << 16
    out = bytearray()
    for _ in range(n):
        low = 20021 * (key & 0xFFFF)
        mixed = (20021 * (high | key >> 16) + 346 * key + (low >> 16)) & 0xFFFF
        key = ((mixed << 16) + (low & 0xFFFF) + 1) & 0xFFFFFFFF
        out.append(mixed & 0xFF)
    return bytes(out)


def canonical(lengths: np.ndarray) -> dict[tuple[int, int], int]:
    """(depth, code) -> symbol."""
    codes, code, depth = {}, 0, 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[symbol])
        if not n:
            continue
        code <<= n - depth
        depth = n
        if code >> n:
            raise ValueError("more codes than a tree has leaves")
        codes[n, code] = symbol
        code += 1
    return codes


def unpack(data: bytes) -> bytes:
    """The script of a DSC member; ValueError if it is none or is cut short."""
    if not data.startswith(MAGIC) or len(data) < HEADER + SYMBOLS:
        raise ValueError("not a DSC member")
    key, size, count = struct.unpack_from("<III", data, len(MAGIC))
    if size > MAX_SIZE:
        raise ValueError("unpacked size too large")
    hidden = np.frombuffer(data, np.uint8, SYMBOLS, HEADER)
    codes = canonical(hidden - np.frombuffer(key_stream(key, SYMBOLS), np.uint8))
    deepest = max((n for n, _ in codes), default=0)
    # The bits as one integer a time would be quadratic: a window over the bytes is kept instead.
    at, window, have, out = HEADER + SYMBOLS, 0, 0, bytearray()

    def take(n: int) -> int:
        nonlocal at, window, have
        while have < n:
            if at >= len(data):
                raise ValueError("member is cut short")
            window, have, at = window << 8 | data[at], have + 8, at + 1
        have -= n
        value = window >> have
        window &= (1 << have) - 1
        return value

    for _ in range(count):
        code = n = 0
        while (symbol := codes.get((n, code))) is None:
            if n >= deepest:
                raise ValueError("bits without a code")
            code, n = code << 1 | take(1), n + 1
        if symbol < 256:
            out.append(symbol)
            continue
        back = take(12) + 2
        if back > len(out):
            raise ValueError("copy from before the beginning")
        for _ in range(symbol - 256 + 2):
            out.append(out[-back])
        if len(out) > size:
            break
    if len(out) != size:
        raise ValueError(f"{size} bytes were announced, {len(out)} came out")
    return bytes(out)
