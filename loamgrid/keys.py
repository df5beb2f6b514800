"""Names, units and byte layouts of trace data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The trace header of SEG-Y revision 1, as first byte (from 1) and name, by width.
FOUR_BYTE_FIELDS = {
    1: "TRACE_SEQUENCE_LINE", 5: "TRACE_SEQUENCE_FILE", 9: "FieldRecord", 13: "TraceNumber", 17: "EnergySourcePoint", 21: "CDP",
    25: "CDP_TRACE", 37: "offset", 41: "ReceiverGroupElevation", 45: "SourceSurfaceElevation", 49: "SourceDepth",
    53: "ReceiverDatumElevation", 57: "SourceDatumElevation", 61: "SourceWaterDepth", 65: "GroupWaterDepth", 73: "SourceX",
    77: "SourceY", 81: "GroupX", 85: "GroupY", 181: "CDP_X", 185: "CDP_Y", 189: "INLINE_3D", 193: "CROSSLINE_3D", 197: "ShotPoint",
    205: "TransductionConstantMantissa", 219: "SourceEnergyDirectionMantissa", 225: "SourceMeasurementMantissa",
    233: "UnassignedInt1", 237: "UnassignedInt2",
}
TWO_BYTE_FIELDS = {
    29: "TraceIdentificationCode", 31: "NSummedTraces", 33: "NStackedTraces", 35: "DataUse", 69: "ElevationScalar",
    71: "SourceGroupScalar", 89: "CoordinateUnits", 91: "WeatheringVelocity", 93: "SubWeatheringVelocity", 95: "SourceUpholeTime",
    97: "GroupUpholeTime", 99: "SourceStaticCorrection", 101: "GroupStaticCorrection", 103: "TotalStaticApplied", 105: "LagTimeA",
    107: "LagTimeB", 109: "DelayRecordingTime", 111: "MuteTimeStart", 113: "MuteTimeEND", 115: "TRACE_SAMPLE_COUNT",
    117: "TRACE_SAMPLE_INTERVAL", 119: "GainType", 121: "InstrumentGainConstant", 123: "InstrumentInitialGain", 125: "Correlated",
    127: "SweepFrequencyStart", 129: "SweepFrequencyEnd", 131: "SweepLength", 133: "SweepType", 135: "SweepTraceTaperLengthStart",
    137: "SweepTraceTaperLengthEnd", 139: "TaperType", 141: "AliasFilterFrequency", 143: "AliasFilterSlope", 145: "NotchFilterFrequency",
    147: "NotchFilterSlope", 149: "LowCutFrequency", 151: "HighCutFrequency", 153: "LowCutSlope", 155: "HighCutSlope",
    157: "YearDataRecorded", 159: "DayOfYear", 161: "HourOfDay", 163: "MinuteOfHour", 165: "SecondOfMinute", 167: "TimeBaseCode",
    169: "TraceWeightingFactor", 171: "GeophoneGroupNumberRoll1", 173: "GeophoneGroupNumberFirstTraceOrigField",
    175: "GeophoneGroupNumberLastTraceOrigField", 177: "GapSize", 179: "OverTravel", 201: "ShotPointScalar",
    203: "TraceValueMeasurementUnit", 209: "TransductionConstantPower", 211: "TransductionUnit", 213: "TraceIdentifier",
    215: "ScalarTraceHeader", 217: "SourceType", 223: "SourceEnergyDirectionExponent", 229: "SourceMeasurementExponent",
    231: "SourceMeasurementUnit",
}
#: First byte to (name, width), in byte order.
TRACE_FIELDS = dict(sorted([(b, (n, 4)) for b, n in FOUR_BYTE_FIELDS.items()] + [(b, (n, 2)) for b, n in TWO_BYTE_FIELDS.items()]))
FIELD_BYTES = {name: byte for byte, (name, _) in TRACE_FIELDS.items()}

#: Binary header fields: name to (first byte in the file from 1, width).
BINARY_FIELDS = {
    "JobID": (3201, 4), "LineNumber": (3205, 4), "ReelNumber": (3209, 4), "Traces": (3213, 2), "AuxTraces": (3215, 2),
    "Interval": (3217, 2), "Samples": (3221, 2), "Format": (3225, 2), "EnsembleFold": (3227, 2), "SortingCode": (3229, 2),
    "MeasurementSystem": (3255, 2), "SEGYRevision": (3501, 2), "ExtendedHeaders": (3505, 2),
}
#: Sample formats: code to bytes per sample (1 IBM float, 2 int32, 3 int16, 5 IEEE float, 8 int8).
SAMPLE_BYTES = {1: 4, 2: 4, 3: 2, 5: 4, 8: 1}

# Where common kinds of files keep their dimensions and coordinates.
LAYOUTS = {
    "standard_3d": {"iline": 189, "xline": 193, "cdp_x": 181, "cdp_y": 185},
    "standard_3d_gath": {"iline": 189, "xline": 193, "cdp_x": 181, "cdp_y": 185, "offset": 37},
    "standard_2d": {"cdp": 21, "cdp_x": 181, "cdp_y": 185},
    "standard_2d_gath": {"cdp": 21, "cdp_x": 181, "cdp_y": 185, "offset": 37},
    "petrel_3d": {"iline": 5, "xline": 21, "cdp_x": 73, "cdp_y": 77},
    "petrel_2d": {"cdp": 21, "cdp_x": 73, "cdp_y": 77},
}
VERTICAL_UNITS = ("ms", "s", "cm", "m", "km", "ft")
VERTICAL_DOMAINS = ("TWT", "DEPTH")
#: Measurement system codes and their units; other codes have none.
MEASUREMENT_UNITS = {1: "m", 2: "ft"}


def layout(name: str) -> dict[str, int]:
    """A copy of a named byte layout."""
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout {name!r}; there are {', '.join(sorted(LAYOUTS))}")
    return dict(LAYOUTS[name])


def check_bytes(bytes_: list[int]) -> None:
    """Fail for bytes at which no trace header field begins."""
    if wrong := [b for b in bytes_ if b not in TRACE_FIELDS]:
        raise ValueError(f"no trace header field begins at bytes {wrong}")


def check_names(names: list[str]) -> None:
    """Fail for names that aren't trace header fields."""
    if wrong := [n for n in names if n not in FIELD_BYTES]:
        raise ValueError(f"unknown trace header fields {wrong}")


def check_vertical(domain: str, units: str | None) -> None:
    if domain.upper() not in VERTICAL_DOMAINS:
        raise ValueError(f"the vertical domain must be one of {VERTICAL_DOMAINS}")
    if units is not None and units not in VERTICAL_UNITS:
        raise ValueError(f"vertical units must be among {VERTICAL_UNITS}")


def dimensionality(columns: list[str]) -> str:
    """2d, 3d, 2dgath or 3dgath by the dimensions among the columns."""
    has = set(columns)
    if "cdp" in has and not has & {"iline", "xline"}:
        kind = "2d"
    elif has & {"iline", "xline"} and "cdp" not in has:
        kind = "3d"
    else:
        raise ValueError("columns must have cdp, or iline or xline, and not both")
    return kind + "gath" * ("offset" in has)


def is_field_byte(byte: Column) -> Column:
    """Whether a trace header field begins at a byte."""
    return byte.isin(list(TRACE_FIELDS))


def kind_of(columns: Column) -> Column:
    """2d, 3d, 2dgath or 3dgath by an array of dimension names, for tables of many volumes; null where these don't fit together."""
    has = lambda *names: F.arrays_overlap(columns, F.array(*map(F.lit, names)))
    kind = F.when(has("cdp") & ~has("iline", "xline"), "2d").when(has("iline", "xline") & ~has("cdp"), "3d")
    return F.concat(kind, F.when(has("offset"), "gath").otherwise(""))


def vertical_dimension(columns: list[str]) -> str:
    """twt, depth or samples; twt and depth together are an error."""
    if {"twt", "depth"} <= set(columns):
        raise ValueError("twt and depth cannot both be vertical dimensions")
    return next((c for c in ("twt", "depth") if c in columns), "samples")
