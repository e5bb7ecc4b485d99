"""Ed25519 signatures after RFC 8032, in plain Python integers, for columns of identities and messages.

Spark has no such function and no package for it is here. A verification is two scalar multiplications, some
milliseconds, so it belongs behind the cheaper checks of age, shape and deduplication.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)  # of -1

Point = tuple[int, int, int, int]  # x = X / Z, y = Y / Z, x * y = T / Z
ZERO: Point = (0, 1, 1, 0)


def _add(a: Point, b: Point) -> Point:
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    g, h = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    x, t, z, y = f - e, h - g, h + g, f + e
    return x * t % P, y * z % P, z * t % P, x * y % P


def _times(n: int, a: Point) -> Point:
    found = ZERO
    while n:
        if n & 1:
            found = _add(found, a)
        a, n = _add(a, a), n >> 1
    return found


def _same(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _x(y: int, odd: int) -> int | None:
    """The x of a y on the curve, with the parity that is asked for."""
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or x == 0 and odd:
        return None
    return P - x if x & 1 != odd else x


_Y = 4 * pow(5, -1, P) % P
BASE: Point = (_x(_Y, 0), _Y, 1, _x(_Y, 0) * _Y % P)


def _packed(a: Point) -> bytes:
    z = pow(a[2], -1, P)
    return (a[1] * z % P | (a[0] * z % P & 1) << 255).to_bytes(32, "little")


def _point(data: bytes) -> Point | None:
    y = int.from_bytes(data, "little")
    odd, y = y >> 255, y & (1 << 255) - 1
    x = _x(y, odd) if y < P else None
    return None if x is None else (x, y, 1, x * y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key_of(seed: bytes) -> bytes:
    """The 32 bytes of the public key of a 32-byte seed."""
    return _packed(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    """The 64 bytes of a signature."""
    a, prefix = _secret(seed)
    key, r = _packed(_times(a, BASE)), _number(prefix, message)
    first = _packed(_times(r, BASE))
    return first + ((r + _number(first, key, message) * a) % ORDER).to_bytes(32, "little")


def verify(key: bytes | None, message: bytes | None, signature: bytes | None) -> bool:
    """Whether the signature is the key's for the message; false for whatever is malformed."""
    if key is None or message is None or signature is None or len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    return _same(_times(s, BASE), _add(r, _times(_number(signature[:32], key, message), a)))


def is_signed(key: Column, message: Column, signature: Column) -> Column:
    """verify() of binary columns, in Arrow batches."""

    @F.pandas_udf("boolean")
    def judged(keys: pd.Series, messages: pd.Series, signatures: pd.Series) -> pd.Series:
        return pd.Series([verify(*x) for x in zip(keys, messages, signatures, strict=True)], dtype=bool)

    return judged(key, message, signature)


def signed(seed: Column, message: Column) -> Column:
    """struct(key, signature) of binary columns, in Arrow batches."""

    @F.pandas_udf("key binary, signature binary")
    def made(seeds: pd.Series, messages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(public_key_of(bytes(s)), sign(bytes(s), bytes(m))) for s, m in zip(seeds, messages, strict=True)], columns=["key", "signature"])

    return made(seed, message)
