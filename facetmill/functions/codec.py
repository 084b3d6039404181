"""A byte compressor for short paths, and its base64 form.

Fixed values of the format: a literal is a byte under 0xC0; a copy is 0xC0 + length and one byte of distance
(under 128), or 0xE0 + length and two bytes of distance, high first; lengths 4 to 31, distances to 32,767.
Text is made ASCII first, by percent-escapes of other characters and of %, so any text comes back.
"""

from __future__ import annotations

import base64
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTEST, LONGEST, FARTHEST = 4, 31, 32_767


def pack(data: bytes) -> bytes:
    """Greedy copies from the last place where the next four bytes stood; data holds bytes under 0xC0 only."""
    if data and max(data) >= 0xC0:
        raise ValueError("bytes of 0xC0 and more can't be literals")
    seen: dict[bytes, int] = {}
    out, at, known = bytearray(), 0, 0
    while at < len(data):
        while known <= at - SHORTEST:  # a source ends where the copy begins, at the latest
            seen[data[known : known + SHORTEST]] = known
            known += 1
        source = seen.get(data[at : at + SHORTEST])
        if source is None or at - source > FARTHEST:
            out.append(data[at])
            at += 1
            continue
        length, distance = SHORTEST, at - source
        while length < LONGEST and at + length < len(data) and data[source + length] == data[at + length]:
            length += 1
        out += bytes([0xC0 | length, distance]) if distance < 128 else bytes([0xE0 | length]) + distance.to_bytes(2, "big")
        at += length
    return bytes(out)


def unpack(data: bytes) -> bytes:
    out, todo = bytearray(), iter(data)
    for b in todo:
        if b < 0xC0:
            out.append(b)
            continue
        try:
            distance = next(todo) if b < 0xE0 else int.from_bytes(bytes([next(todo), next(todo)]), "big")
        except StopIteration:
            raise ValueError("the data ends within a copy") from None
        if not 0 < distance <= len(out):
            raise ValueError("a copy begins before the data")
        piece = bytes(out[-distance:])
        length = b & 31
        out += (piece * (length // distance + 1))[:length]
    return bytes(out)


def encode_path(text: str) -> str:
    plain = "".join(c if c != "%" and c.isascii() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)
    return base64.b64encode(pack(plain.encode())).decode()


def decode_path(code: str) -> str:
    return unquote(unpack(base64.b64decode(code)).decode())


def path_code(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(encode_path, na_action="ignore"), "string")(c)


def path_of_code(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(decode_path, na_action="ignore")

    return F.pandas_udf(run, "string")(c)
