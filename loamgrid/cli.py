"""Command-line pipeline: commands after each other pass a volume on.

    python -m loamgrid.cli -f in.sgy ebcidc
    python -m loamgrid.cli -f in.sgy scan -m 1000
    python -m loamgrid.cli -f in.sgy scrape -h -e
    python -m loamgrid.cli -f in.sgy sgy -d iline 189 -d xline 193 crop -c iline 10 20 sgy -o out.sgy
    python -m loamgrid.cli -f in.sgy sgy -d iline 189 -d xline 193 volume -o out.volume
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import dataclass

from pyspark.sql import SparkSession

from . import __version__
from .functions.text import as_lines
from .keys import FIELD_BYTES, LAYOUTS, TRACE_FIELDS
from .operators.stats import header_stats
from .sources import segy, tables
from .volume import Volume

COMMANDS = ("ebcidc", "scan", "scrape", "sgy", "volume", "crop", "print")
log = logging.getLogger("loamgrid")


@dataclass
class State:
    spark: SparkSession
    path: str
    volume: Volume | None = None


def parser_of(command: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=command)
    if command == "ebcidc":
        p.add_argument("-s", "--set", help="a text file with the new header")
    elif command == "scan":
        p.add_argument("-m", "--max-traces", type=int, default=1000)
    elif command == "scrape":
        p.add_argument("-e", "--ebcidc", action="store_true")
        p.add_argument("-t", "--trace-headers", action="store_true")
        p.add_argument("-o", "--output")
    elif command == "sgy":
        p.add_argument("-d", "--dimension", nargs=2, action="append", default=[], metavar=("NAME", "BYTE"))
        p.add_argument("-v", "--variable", nargs=2, action="append", default=[], metavar=("NAME", "BYTE"))
        p.add_argument("-o", "--output")
    elif command == "volume":
        p.add_argument("-o", "--output")
    elif command == "crop":
        p.add_argument("-c", "--crop", nargs=3, action="append", default=[], metavar=("DIM", "MIN", "MAX"))
    return p


def split_commands(words: list[str]) -> list[list[str]]:
    """Words by command; a command begins at each command name that isn't an option's value."""
    out: list[list[str]] = []
    for i, w in enumerate(words):
        if w in COMMANDS and not (i and words[i - 1] in ("-d", "-v", "-c", "-o", "-s", "--dimension", "--variable", "--crop", "--output", "--set")):
            out.append([w])
        elif out:
            out[-1].append(w)
        else:
            raise SystemExit(f"unknown command {w!r}; there are {', '.join(COMMANDS)}")
    return out


def set_text(path: str, lines: list[str]) -> None:
    raw = b"".join(as_lines(lines)).decode("utf-8", "replace").encode("cp500", "replace")[:3200]
    with open(path, "r+b") as f:
        f.write(raw.ljust(3200, b"\x40"))


def run(state: State, words: list[str]) -> State:
    command = words[0]
    a = parser_of(command).parse_args(words[1:])
    spark, path = state.spark, state.path
    if command == "ebcidc":
        if a.set:
            with open(a.set) as f:
                set_text(path, f.read().split("\n"))
        else:
            print(segy.head(path, "big").text)
    elif command == "scan":
        headers = segy.read_headers(spark, path, a.max_traces)
        places = spark.createDataFrame(list(FIELD_BYTES.items()), "field string, byte_loc int")
        found = header_stats(headers, [c for c in headers.columns if c not in ("file", "tracen")]).join(places, "field")
        found.select("field", "byte_loc", "min", "max", "mean").orderBy("byte_loc").show(100, False)
    elif command == "scrape":
        out = a.output or path
        if a.ebcidc or not a.trace_headers:
            spark.createDataFrame([(segy.head(path, "big").text,)], "value string").write.mode("overwrite").text(f"{out}.txt")
        if a.trace_headers or not a.ebcidc:
            tables.write_headers(segy.read_headers(spark, path), f"{out}.head.csv")
    elif command == "sgy":
        dims, extras = ({n: int(b) for n, b in pairs} for pairs in (a.dimension, a.variable))
        if a.output and state.volume is not None:
            log.info("%d traces written", state.volume.to_segy(a.output, dims or None, extras or None))
        else:
            state.volume = Volume.open_segy(spark, path, dims, extras)
    elif command == "volume":
        if a.output and state.volume is not None:
            state.volume.save(a.output)
        else:
            state.volume = Volume.load(spark, path)
    elif command == "crop":
        if state.volume is None:
            raise SystemExit("crop comes after a command that loads")
        state.volume = state.volume.crop(**{d: (float(low), float(high)) for d, low, high in a.crop})
    elif command == "print":
        if state.volume is not None:
            state.volume.traces.printSchema()
            print(json.dumps({"dims": state.volume.dims, "ns0": state.volume.ns0, "dt": state.volume.dt}))
    return state


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="loamgrid", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-f", "--file")
    p.add_argument("--debug-level", default="INFO")
    p.add_argument("-k", "--keys", action="store_true", help="print header fields with their bytes, and the known layouts")
    p.add_argument("-v", "--version", action="store_true", help="print the version")
    p.add_argument("commands", nargs=argparse.REMAINDER)
    a = p.parse_args(words)
    logging.basicConfig(level=a.debug_level.upper())
    if a.version:
        print(__version__)
    if a.keys:
        for byte, (name, *_) in sorted(TRACE_FIELDS.items()):
            print(f"{byte:4d} {name}")
        for name, fields in LAYOUTS.items():
            print(f"{name}: {', '.join(f'{k} {b}' for k, b in fields.items())}")
    commands = split_commands(a.commands)
    if commands and not a.file:
        log.error("give a file with -f")
        return 0
    spark = spark or SparkSession.builder.appName("loamgrid").getOrCreate()
    state = State(spark, a.file)
    for c in commands:
        state = run(state, c)
    return 0


if __name__ == "__main__":
    sys.exit(main())
