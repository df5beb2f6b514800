"""Bytes of SEG-Y files, as numpy arrays."""

from __future__ import annotations

import numpy as np

from .keys import BINARY_FIELDS, SAMPLE_BYTES, TRACE_FIELDS

TEXT, PROLOGUE, HEADER = 3200, 3600, 240


def order(endian: str) -> str:
    if endian not in ("big", "little"):
        raise ValueError("endian must be big or little")
    return ">" if endian == "big" else "<"


def ibm_to_float(words: np.ndarray) -> np.ndarray:
    """IBM System/360 single precision words (uint32) as float64."""
    sign = np.where(words >> 31, -1.0, 1.0)
    exponent = ((words >> 24) & 0x7F).astype(np.float64) - 64
    return sign * ((words & 0xFFFFFF) / float(1 << 24)) * np.power(16.0, exponent)


def float_to_ibm(values: np.ndarray) -> np.ndarray:
    """float values as IBM words (uint32); 0 and values too small for the format are 0, too large ones the largest."""
    x = np.abs(np.nan_to_num(np.asarray(values, dtype=np.float64)))
    _, two = np.frexp(x)
    e = -((-two) // 4)  # 16 ** (e - 1) <= x < 16 ** e, as two = floor(log2 x) + 1
    fraction = np.rint(np.ldexp(x, 24 - 4 * e)).astype(np.int64)
    over = fraction >= 1 << 24
    fraction, e = np.where(over, fraction >> 4, fraction), np.where(over, e + 1, e)
    fraction, e = np.where(e > 63, 0xFFFFFF, fraction), np.minimum(e, 63)
    keep = (x > 0) & (e >= -64)
    word = (np.signbit(values).astype(np.int64) << 31) | ((e + 64) << 24) | fraction
    return np.where(keep, word, 0).astype(np.uint32)


def decode_samples(raw: np.ndarray, kind: int, endian: str) -> np.ndarray:
    """float32 samples of rows of bytes."""
    o = order(endian)
    if kind == 1:
        return ibm_to_float(raw.view(f"{o}u4").astype(np.uint32)).astype(np.float32)
    types = {2: "i4", 3: "i2", 5: "f4", 8: "i1"}
    if kind not in types:
        raise ValueError(f"sample format {kind} isn't supported")
    return raw.view(f"{o}{types[kind]}").astype(np.float32)


def encode_samples(values: np.ndarray, kind: int, endian: str) -> bytes:
    o = order(endian)
    if kind == 1:
        return float_to_ibm(values).astype(f"{o}u4").tobytes()
    types = {2: "i4", 3: "i2", 5: "f4", 8: "i1"}
    return np.asarray(values).astype(f"{o}{types[kind]}").tobytes()


def decode_headers(raw: np.ndarray, bytes_: list[int], endian: str) -> dict[int, np.ndarray]:
    """Header fields (by first byte) of rows of 240 bytes, as int32."""
    o, out = order(endian), {}
    for b in bytes_:
        width = TRACE_FIELDS[b][1]
        out[b] = np.ascontiguousarray(raw[:, b - 1 : b - 1 + width]).view(f"{o}i{width}").astype(np.int32).reshape(-1)
    return out


def encode_field(block: np.ndarray, byte: int, values: np.ndarray, endian: str) -> None:
    """Put a header field (by first byte) into rows of bytes."""
    width = TRACE_FIELDS[byte][1]
    kind = "u" if byte in (115, 117) else "i"  # counts and intervals have no sign
    block[:, byte - 1 : byte - 1 + width] = np.ascontiguousarray(values).astype(f"{order(endian)}{kind}{width}").view(np.uint8).reshape(len(block), width)


def decode_binary(prologue: bytes, endian: str) -> dict[str, int]:
    """Fields of the binary header; sample count and interval have no sign."""
    o = order(endian)
    return {n: int(np.frombuffer(prologue[b - 1 : b - 1 + w], f"{o}{'u' if n in ('Samples', 'Interval') else 'i'}{w}")[0]) for n, (b, w) in BINARY_FIELDS.items()}


def encode_binary(fields: dict[str, int], endian: str) -> bytes:
    o, out = order(endian), bytearray(PROLOGUE - TEXT)
    for name, v in fields.items():
        b, w = BINARY_FIELDS[name]
        out[b - 1 - TEXT : b - 1 - TEXT + w] = np.array([v]).astype(f"{o}{'u' if name in ('Samples', 'Interval') else 'i'}{w}").tobytes()
    return bytes(out)


def decode_text(block: bytes) -> str:
    """3200 bytes as 40 lines; EBCDIC unless all bytes are ASCII."""
    ascii_ = all(b < 128 for b in block)
    text = block.decode("ascii" if ascii_ else "cp500").replace("\x00", " ")
    return "\n".join(text[i : i + 80] for i in range(0, TEXT, 80))


def layout_of(size: int, binary: dict[str, int]) -> tuple[int, int, int]:
    """First trace byte, bytes of a trace and number of traces of a file of ``size`` bytes."""
    kind = binary["Format"]
    if kind not in SAMPLE_BYTES:
        raise ValueError(f"sample format {kind} isn't supported")
    first = PROLOGUE + TEXT * max(0, binary["ExtendedHeaders"])
    stride = HEADER + binary["Samples"] * SAMPLE_BYTES[kind]
    if (size - first) % stride or size < first:
        raise ValueError(f"the file's {size} bytes don't hold whole traces of {stride} bytes after {first}")
    return first, stride, (size - first) // stride
