"""String functions over menu, calendar and label text."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# The blanks stripped by JavaScript and by Python differ in a few characters.
_SHARED = [(0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029)]
_SHARED += [(0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_SPANS = {"js": [*_SHARED, (0xFEFF, 0xFEFF)], "python": [*_SHARED, (0x1C, 0x1F), (0x85, 0x85)]}


def _ranges(spans: list[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)


def _blank(spans: list[tuple[int, int]]) -> str:
    # The wide blanks sit behind one range test, so plain text is matched in two steps.
    plain, wide = [s for s in spans if s[1] < 0x80], [s for s in spans if s[0] >= 0x80]
    return rf"[{_ranges(plain)}[\x{{80}}-\x{{FFFF}}&&[{_ranges(wide)}]]]"


BLANKS = {f: "".join(chr(c) for a, b in spans for c in range(a, b + 1)) for f, spans in _SPANS.items()}
# A whole class, and the inside of one.
BLANK = {f: _blank(spans) for f, spans in _SPANS.items()}
BLANK_CLASS = {f: _ranges(spans) for f, spans in _SPANS.items()}
# JavaScript's line ends.
EOL_CLASS = r"\n\r\x{2028}\x{2029}"


def trim_ws(value: Column | str, flavour: str = "js") -> Column:
    """Strip every Unicode blank at both ends; Spark's ``trim`` knows U+0020 only."""
    return F.btrim(col(value), F.lit(BLANKS[flavour]))


@F.arrow_udf(T.StringType())
def _decomposed(values: pa.Array) -> pa.Array:
    """Compatibility decomposition (NFKD)."""
    return pc.utf8_normalize(values, form="NFKD")


def normalize_key(value: Column | str) -> Column:
    """Lower-case, decompose (NFKD), turn runs outside ``[a-z0-9]`` into one space, trim.

    Only texts with a non-ASCII character travel to the Arrow function that decomposes them. It
    is deterministic, so filters on other columns still reach the scan.
    """
    lowered = F.lower(col(value))
    odd = lowered.rlike(r"[^\x00-\x7F]")
    plain = F.coalesce(_decomposed(F.when(odd, lowered)), lowered)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slugify(value: Column | str) -> Column:
    """File-name form of a name; letters and digits of any script are kept."""
    blank = BLANK["python"]
    odd = rf"[^\p{{L}}\p{{N}}_{BLANK_CLASS['python']}-]+"
    kept = F.regexp_replace(col(value), odd, "")
    joined = F.regexp_replace(kept, f"[-{blank}]+", "_")
    return F.lower(F.btrim(joined, F.lit("_")))


def first_line(value: Column | str) -> Column:
    return F.substring_index(trim_ws(value, "python"), "\n", 1)


def split_name_hours(line: Column | str) -> tuple[Column, Column]:
    """Split a restaurant line at its first `` - `` into (name, hours)."""
    line = col(line)
    at = F.locate(" - ", line)
    name = F.when(at == 0, line).otherwise(F.substring_index(line, " - ", 1))
    hours = F.when(at == 0, F.lit("")).otherwise(F.substr(line, at + 3))
    return trim_ws(name), trim_ws(hours)


def contains_ci(value: Column | str, query: str) -> Column:
    return F.contains(F.lower(col(value)), F.lit(query.strip().lower()))


def lookup_key(item_key: Column | str, rest_key: Column | str | None = None) -> Column:
    prefix = F.lit("*") if rest_key is None else col(rest_key)
    return F.concat_ws("/", prefix, col(item_key))


def split_lookup_key(key: Column | str) -> tuple[Column, Column]:
    """(rest_key, item_key), cut at the first slash; both null when there is none."""
    key = col(key)
    at = F.locate("/", key)
    return (
        F.when(at > 0, F.substring_index(key, "/", 1)),
        F.when(at > 0, F.substr(key, at + 1)),
    )


# --- menu lines ---------------------------------------------------------------------------

_JS = BLANK_CLASS["js"]
CATEGORY_LINE = rf"^ {{2}}[^{_JS}][^{EOL_CLASS}]*:\z"


def classify_menu_line(line: Column | str) -> Column:
    """``blank``, ``restaurant``, ``category``, ``item`` or ``other``."""
    line = col(line)
    trimmed = trim_ws(line)
    return (
        F.when(trimmed == "", "blank")
        .when(~F.startswith(line, F.lit(" ")), "restaurant")
        .when(line.rlike(CATEGORY_LINE), "category")
        .when(F.startswith(trimmed, F.lit("- ")), "item")
        .otherwise("other")
    )


def category_name(line: Column | str) -> Column:
    return F.regexp_replace(trim_ws(line), r":\z", "")


def item_name(line: Column | str) -> Column:
    return trim_ws(F.substr(trim_ws(line), F.lit(3)))
