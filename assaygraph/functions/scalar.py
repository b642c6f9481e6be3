"""Column functions (Spark built-ins only, so they stay inside codegen)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
NUMBER_PATTERN = r"(\d+\.?\d*)"          # first unsigned decimal number in a text
UNNAMED_PATTERN = r"(?i)^Unnamed"        # spreadsheet index columns
LABEL_MAP = {                            # target text (trimmed, lower-cased) -> class
    "nontoxic": 0, "toxic": 1, "non-toxic": 0, "non toxic": 0, "1": 1, "0": 0,
}
CLASS_TEXT = {0: "Non-Toxic", 1: "Toxic"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:                                   # C1: all surrounding white space
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def lower(c) -> Column:                                   # C2
    return F.lower(_c(c))


def replace_regex(c, pattern: str, repl: str) -> Column:  # C3
    return F.regexp_replace(_c(c), pattern, repl)


def extract_first(c, pattern: str = NUMBER_PATTERN) -> Column:  # C4: '' (no match) -> NULL
    return F.nullif(F.regexp_extract(_c(c), pattern, 1), F.lit(""))


def contains_regex(c, pattern: str, ignore_case: bool = False) -> Column:  # C5
    return _c(c).rlike(("(?i)" if ignore_case else "") + pattern)


def contains_literal(c, sub: str) -> Column:             # C6
    return F.contains(_c(c), F.lit(sub))


def replace_literal(c, a: str, b: str) -> Column:         # C7
    return F.replace(_c(c), F.lit(a), F.lit(b))


def starts_with(c, prefix: str) -> Column:                # C8
    return F.startswith(_c(c), F.lit(prefix))


def ends_with(c, suffix: str) -> Column:
    return F.endswith(_c(c), F.lit(suffix))


def to_text(c) -> Column:                                 # C10
    return _c(c).cast("string")


def try_double(c) -> Column:                              # C11
    """``try_cast(x AS double)``: bad text -> NULL (Spark 4 ANSI plain cast raises)."""
    return _c(c).try_cast("double")


to_number_or_null = try_double


def to_int(c) -> Column:                                  # C12
    return _c(c).cast("int")


def fill_null(c, value) -> Column:                        # C13
    return F.coalesce(_c(c), F.lit(value))


def is_null(c) -> Column:                                 # C14
    return _c(c).isNull()


def map_values(c, mapping: Mapping, default=None) -> Column:  # C15
    out = None
    for k, v in mapping.items():
        out = (F.when(_c(c) == F.lit(k), F.lit(v)) if out is None else out.when(_c(c) == F.lit(k), F.lit(v)))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def abs_(c) -> Column:                                    # C16
    return F.abs(_c(c))


def softmax(arr) -> Column:                               # C17
    a = _c(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(arr) -> Column:                                # C17: first index of the max, 0-based
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def relu(c) -> Column:                                    # C18
    return F.greatest(_c(c), F.lit(0.0))


def tanh(c) -> Column:
    return F.tanh(_c(c))


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(c)))


def clamp_min(c, lo) -> Column:                           # C19
    return F.greatest(_c(c), F.lit(lo))


def linspace(a: float, b: float, n: int) -> Column:       # C20
    step = (b - a) / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(a) + i * F.lit(step))


def ordered_pair(a, b) -> tuple[Column, Column]:          # C21
    return F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))


def class_text(c) -> Column:                              # C22
    return map_values(c, CLASS_TEXT)


def percent_text(c) -> Column:
    return F.format_string("%.2f%%", _c(c) * 100.0)


def run_stamp(ts) -> Column:                              # C23
    return F.date_format(_c(ts), "yyyyMMddHHmmss")


def is_digits(c) -> Column:
    return _c(c).rlike("^[0-9]+$")


def json_get(c, key: str, default=None) -> Column:        # C24
    v = F.get_json_object(_c(c), f"$.{key}")
    return F.coalesce(v, F.lit(default)) if default is not None else v


def threshold(score, t) -> Column:                        # C25
    return (_c(score) >= (t if isinstance(t, Column) else F.lit(t))).cast("int")


def decimal_comma(c) -> Column:                           # P8
    return F.replace(_c(c).cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def extract_number(c, fill: float | None = 0.0) -> Column:  # P6
    v = extract_first(_c(c).cast("string")).try_cast("double")
    return F.coalesce(v, F.lit(fill)) if fill is not None else v


def label_class(c) -> Column:                             # P9: NULL -> row to drop
    norm = F.regexp_replace(F.lower(strip(_c(c).cast("string"))), r"^([01])\.0+$", "$1")   # 1.0 is the class 1
    return map_values(norm, LABEL_MAP).cast("int")
