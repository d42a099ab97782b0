"""The part of CBOR (RFC 8949) that bundles use: unsigned integers, byte and text strings, arrays, maps."""

from __future__ import annotations


class CborError(ValueError):
    pass


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise CborError("number too large")


def encode(value) -> bytes:
    """Canonical form: shortest heads, map pairs by encoded key."""
    if isinstance(value, bool) or value is None:
        raise CborError(f"no encoding for {value!r}")
    if isinstance(value, int):
        if value < 0:
            raise CborError("negative number")
        return _head(0, value)
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, str):
        data = value.encode()
        return _head(3, len(data)) + data
    if isinstance(value, list | tuple):
        return _head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        pairs = sorted((encode(k), encode(v)) for k, v in value.items())
        return _head(5, len(pairs)) + b"".join(k + v for k, v in pairs)
    raise CborError(f"no encoding for {type(value).__name__}")


def decode(data: bytes):
    value, end = _decode(data, 0, 0)
    if end != len(data):
        raise CborError("bytes after the value")
    return value


def _decode(data: bytes, at: int, depth: int):
    if depth > 128:
        raise CborError("nested too deep")
    if at >= len(data):
        raise CborError("ends early")
    major, info = data[at] >> 5, data[at] & 31
    at += 1
    if info < 24:
        n = info
    elif info <= 27:
        size = 1 << info - 24
        if at + size > len(data):
            raise CborError("ends early")
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    else:
        raise CborError(f"unsupported length {info}")
    if major == 0:
        return n, at
    if major in (2, 3):
        if at + n > len(data):
            raise CborError("ends early")
        part = data[at : at + n]
        try:
            return (part if major == 2 else part.decode()), at + n
        except UnicodeDecodeError as e:
            raise CborError("text is not UTF-8") from e
    if major == 4:
        out = []
        for _ in range(n):
            v, at = _decode(data, at, depth + 1)
            out.append(v)
        return out, at
    if major == 5:
        made: dict = {}
        for _ in range(n):
            k, at = _decode(data, at, depth + 1)
            if isinstance(k, list | dict) or k in made:
                raise CborError("bad or repeated key")
            made[k], at = _decode(data, at, depth + 1)
        return made, at
    raise CborError(f"unsupported type {major}")
