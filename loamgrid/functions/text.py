"""Text headers: 40 lines of 80 characters, as column functions and as helpers for writing files."""

from __future__ import annotations

import getpass
import re
import textwrap
import warnings
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

LINES, WIDTH = 40, 80


# ---------------------------------------------------------------- columns
def fix_bad_chars(text: Column) -> Column:
    """Every character beyond ASCII becomes #."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "#")


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def fix_nulls(text: Column) -> Column:
    """NUL characters become spaces."""
    return F.translate(text, "\x00", " ")


def has_counter(line: Column) -> Column:
    """Whether a line begins with C and its number."""
    return line.rlike(r"^C[\s|\d]\d")


def counted(line: Column, number: Column) -> Column:
    """A line with its number before it, unless it has one, padded to 80."""
    bare = F.regexp_replace(line, r"\s+$", "")
    head = F.concat(F.lit("C"), F.lpad(number.cast("string"), 2, " "), F.lit(" "))
    return F.rpad(F.when(has_counter(bare), bare).otherwise(F.concat(head, bare)), WIDTH, " ")


def cut_bytes(line: Column, n: int = WIDTH) -> Column:
    """The first n bytes of a line in UTF-8."""
    return F.substring(F.encode(line, "UTF-8"), 1, n)


def hard_wrapped(text: Column, width: int = WIDTH) -> Column:
    """Pieces of ``width`` characters of each line of a text, padded; an empty line is one piece."""
    split = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / width).cast("int"), F.lit(1)) - 1), lambda i: F.rpad(F.substring(x, i * width + 1, F.lit(width)), width, " "))
    return F.flatten(F.transform(F.split(text, "\n"), split))


def lines_of_map(texts: Column) -> Column:
    """40 padded lines from a map of line number to text."""
    return F.transform(F.sequence(F.lit(1), F.lit(LINES)), lambda i: F.rpad(F.coalesce(F.try_element_at(texts, i), F.lit("")), WIDTH, " "))


def split_counter(line: Column) -> tuple[Column, Column]:
    """A line's number mark (C and two characters) and the rest."""
    pattern = r"^(C[\s|\d]\d)?(.*)$"
    return F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)


def clean_map(texts: Column, n: int = 75) -> Column:
    """Lines 1 to 40 of a map, cut to n characters."""
    return F.transform_values(F.map_filter(texts, lambda k, v: (k >= 1) & (k <= LINES)), lambda k, v: F.left(v, F.lit(n)))


def human_bytes(n: Column) -> Column:
    """A number of bytes in steps of 1024, with up to two decimals."""
    n = n.cast("double")
    out = None
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB", "PB")))):
        number = F.regexp_replace(F.format_string("%.2f", n / F.lit(float(1024**i))), r"\.?0+$", "")
        text = F.concat(number, F.lit(" " + unit))
        out = text if out is None else F.when(n < float(1024 ** (i + 1)), text).otherwise(out)
    return out


# ---------------------------------------------------------------- headers for files
def as_lines(header: str | list[str] | dict[int, str] | bytes, line_counter: bool = True) -> list[bytes]:
    """40 lines of 80 bytes from a text, lines, a map of line number to text, or bytes."""
    if isinstance(header, bytes):
        if len(header) > LINES * WIDTH:
            warnings.warn("the text header is cut to 3200 bytes", UserWarning, stacklevel=3)
        raw = header[: LINES * WIDTH].ljust(LINES * WIDTH)
        return [raw[i : i + WIDTH] for i in range(0, LINES * WIDTH, WIDTH)]
    if isinstance(header, str):
        lines = [piece for line in header.split("\n") for piece in (textwrap.wrap(line, WIDTH, drop_whitespace=False) or [""])]
    elif isinstance(header, dict):
        lines = [header.get(i, "") for i in range(1, LINES + 1)]
    elif isinstance(header, list):
        lines = list(header)
    else:
        raise ValueError("a text header is a string, a list, a dict or bytes")
    lines += [""] * (LINES - len(lines))
    if len(lines) > LINES:
        warnings.warn("the text header is cut to 40 lines", UserWarning, stacklevel=3)
    out = []
    for i, line in enumerate(lines[:LINES], 1):
        line = line.rstrip()
        if line_counter and not re.match(r"C[\s|\d]\d", line):
            line = f"C{i:2d} {line}"
        if len(line) > WIDTH + 1:
            warnings.warn(f"line {i} of the text header is cut to 80 characters", UserWarning, stacklevel=3)
        out.append(line.encode()[:WIDTH].ljust(WIDTH))
    return out


def default_header(override: dict[int, str] | None = None, user: str | None = None) -> dict[int, str]:
    """Lines that say where a file comes from and who wrote it; ``override`` goes first."""
    now = datetime.now()
    if user is None:
        try:
            user = getpass.getuser()
        except (KeyError, OSError):  # a system without names
            user = ""
    lines = {1: f"written by loamgrid {now:%Y-%m-%d %H:%M:%S} {user}".rstrip(), 4: "sample format and geometry: see the binary header", 40: "END TEXTUAL HEADER"}
    lines |= override or {}
    return {k: v[:75] for k, v in lines.items() if 1 <= k <= LINES}


def byte_map_lines(byte_map: dict[str, int], width: int = 75) -> list[str]:
    """Lines that name the bytes of header fields."""
    return textwrap.wrap(" ".join(f"{name}: {byte}," for name, byte in byte_map.items()), width)
