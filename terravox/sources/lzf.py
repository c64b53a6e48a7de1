"""The LZF block format: literal runs and back references."""

from __future__ import annotations


def decompress(data: bytes, size: int) -> bytes:
    """``size`` bytes out of an LZF block."""
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        control = data[at]
        at += 1
        if control < 32:  # that many literals and one more
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        back = len(out) - ((control & 31) << 8) - data[at] - 1
        at += 1
        if back < 0:
            raise ValueError("LZF: a reference before the start")
        length += 2
        while length > 0:  # a copy may overlap what it writes
            part = out[back : back + length]
            out += part
            back += len(part)
            length -= len(part)
    if len(out) != size:
        raise ValueError(f"LZF: {len(out)} bytes, expected {size}")
    return bytes(out)


def compress(data: bytes) -> bytes:
    """A valid block made of literals alone."""
    return b"".join(bytes([min(32, len(data) - i) - 1]) + data[i : i + 32] for i in range(0, len(data), 32))
