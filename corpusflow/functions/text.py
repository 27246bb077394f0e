"""Text and label scalars. All are JVM-side column expressions.

Python's ``\\s`` and ``str.strip`` are Unicode-aware and also treat U+001C..U+001F as
whitespace; Java's ``(?U)\\s`` lacks those four, so the class below adds them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python-compatible whitespace class and its complement (for \S).
WS = r"[\s\x{1c}-\x{1f}]"
NON_WS = r"[^\s\x{1c}-\x{1f}]"
_U = "(?U)"

# Pandas read_csv default NA tokens.
PANDAS_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Unicode blocks for script detection.
SCRIPT_RANGES = {
    "hi": "ऀ-ॿ",   # Devanagari
    "kn": "ಀ-೿",   # Kannada
    "ta": "஀-௿",   # Tamil
    "ml": "ഀ-ൿ",   # Malayalam
}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(col) -> Column:
    """``re.sub(r'\\s+', ' ', x)`` with Python's whitespace class."""
    return F.regexp_replace(_c(col), _U + WS + "+", " ")


def py_strip(col) -> Column:
    """``str.strip()`` (Unicode whitespace at both ends)."""
    return F.regexp_replace(_c(col), _U + "^" + WS + "+|" + WS + "+$", "")


def null_tokens(df, cols, tokens=PANDAS_NA):
    """The NA tokens pandas turns into null on read become null."""
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c).isin(*tokens), None).otherwise(F.col(c)))
    return df


def compose_text(*cols, null_literal: str = "nan") -> Column:
    """``str(a) + " " + str(b)``; a null part prints as ``nan`` (pandas), so the
    row survives the later null drop. ``null_literal=""`` gives the sane form."""
    return F.concat_ws(" ", *[F.coalesce(_c(c).cast("string"), F.lit(null_literal)) for c in cols])


def map_label(col, mapping: dict) -> Column:
    """Dictionary label map; unknown values become null."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(col))


def binarise_label(col) -> Column:
    """0 -> 0, anything else (null included) -> 1."""
    return F.when(_c(col) == 0, F.lit(0)).otherwise(F.lit(1))


def cast_label(col) -> Column:
    """P5: integer cast; a value that does not cast becomes null (sources check it)."""
    return _c(col).try_cast("int")


def normalise_label(col, mode: str = "strict", on_invalid: str = "error") -> Column:
    """``str(x).strip().lower()``; real/0 -> 0, fake/1 -> 1.

    ``mode="lenient"`` also takes ``0.0``/``1.0`` and otherwise ``int(float(x))``
    (truncation toward zero). Unknown values raise (``on_invalid="error"``, as the
    reference does) or become null (``on_invalid="null"``).
    """
    s = F.lower(py_strip(_c(col).cast("string")))
    zero, one = ["real", "0"], ["fake", "1"]
    if mode == "lenient":
        zero, one = zero + ["0.0"], one + ["1.0"]
    # NaN, infinities and values outside INT are invalid labels (null / error below)
    rest = s.try_cast("double").try_cast("int") if mode == "lenient" else F.lit(None).cast("int")
    bad = (F.raise_error(F.concat(F.lit("Unknown label value: "), F.coalesce(s, F.lit("none"))))
           .cast("int") if on_invalid == "error" else F.lit(None).cast("int"))
    return (F.when(s.isin(*zero), F.lit(0))
            .when(s.isin(*one), F.lit(1))
            .when(rest.isNotNull(), rest)
            .otherwise(bad))


def flip_polarity(col) -> Column:
    """Convert between fake=1 and fake=0 conventions."""
    return (F.lit(1) - _c(col)).cast("int")


def domain(col, default: str = "unknown") -> Column:
    """Domain from a source column, null -> default."""
    return F.coalesce(_c(col), F.lit(default))


def detect_script(col, ranges: dict | None = None, default: str = "en") -> Column:
    """First matching script block wins, else ``default``."""
    ranges = ranges or {"hi": SCRIPT_RANGES["hi"]}
    out = None
    for code, rng in ranges.items():
        cond = _c(col).rlike("[" + rng + "]")
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out.otherwise(F.lit(default))


def clean_text_a(col) -> Column:
    """Lower -> drop ``http\\S+``/``www\\S+`` (no word boundary) -> collapse
    whitespace -> strip."""
    x = F.lower(_c(col).cast("string"))
    x = F.regexp_replace(x, _U + "(?:http|www)" + NON_WS + "+", "")
    # after the collapse every whitespace run is one U+0020, so trim == str.strip
    return F.trim(collapse_ws(x))


def clean_text_b(col) -> Column:
    """Null -> ""; drop ``http\\S+``, ``www\\.\\S+`` and ``\\S+@\\S+``; collapse;
    strip; case kept."""
    x = F.coalesce(_c(col).cast("string"), F.lit(""))
    x = F.regexp_replace(x, _U + "http" + NON_WS + "+|www\\." + NON_WS + "+", "")
    # a match always spans a whole word (greedy on both sides), so anchoring it at a
    # word start is equivalent and keeps the backtracking linear in the word length
    x = F.regexp_replace(x, _U + "(?<!" + NON_WS + ")" + NON_WS + "+@" + NON_WS + "+", "")
    return F.trim(collapse_ws(x))


def augment_text(col, method: str = "none") -> Column:
    """``none`` or ``lowercase``."""
    return F.lower(_c(col)) if method == "lowercase" else _c(col)


def pct(n, total) -> Column:
    """P20: share in percent, one decimal."""
    return F.round(F.lit(100.0) * _c(n) / _c(total), 1)


def decode_label(col, names=("FAKE", "TRUE")) -> Column:
    """Class id -> name (index = class id)."""
    out = None
    for i, name in enumerate(names):
        out = F.when(_c(col) == i, F.lit(name)) if out is None else out.when(_c(col) == i, F.lit(name))
    return out


def py_fixed(col, digits: int = 1) -> Column:
    """Python ``f"{x:.{digits}f}"``: ``format_number`` rounds the exact binary value
    half-even like Python; only its thousands separators need removing."""
    return F.regexp_replace(F.format_number(_c(col), digits), ",", "")
