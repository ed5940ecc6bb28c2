"""Personal data in texts: patterns propose spans, checksums confirm them, context scores them.

For each kind a regular expression proposes spans, leftmost and without overlap; a validator
(part range, Luhn, mod-97, digit count) drops those that fail; words close to a span raise its
score. The base kinds (email, ip, card, phone) stay whatever their score. The further kinds are
kept by evidence: an account number (``iban``) must pass mod-97; a ``ssn`` has only weak form
rules and needs a context word nearby. Spaces may stand in an account number, so its end cannot be
seen from its form: the pattern proposes its first four characters and looks ahead, and every end
of a word behind them is tried with mod-97, that of the country's length first, then the longest.

Patterns are written so that matching takes time in proportion to the text: runs are possessive,
and a run is entered at its first character or where the last match ended, which finds the same
spans as trying every character. Offsets come from the lengths of the texts between matches. All
steps are column expressions; a text is searched for a kind only if a cheap test finds one of its
necessary characters.

Results: offsets count code points, ends are exclusive. A null text counts as empty and has no
spans; repeated rows give repeated results; texts of any length are searched whole; an empty
table gives an empty one. Input columns called like an output give way to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, quoted, without

CONTEXT = 40  # characters looked at on both sides of a span


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``valid``: SQL condition on the matched text ``x``. ``needs``: pattern that a text with a match must contain, cheap to search. ``words``: context
    words (lower case). ``score``: of a confirmed span; ``with_word``: with a context word nearby.
    Spans below ``least`` are dropped. ``extent``: SQL for the length of the span from ``x``, null if
    there is none; ``x`` then is the match with what group 1 of the pattern saw ahead of it.
    """

    name: str
    pattern: str
    needs: str
    valid: str
    words: Sequence[str]
    score: float
    with_word: float
    least: float = 0.0
    extent: str | None = None


def _digits(span: str) -> str:
    return f"regexp_replace({span}, '[^0-9]', '')"


def _count(span: str, low: int, high: int) -> str:
    return f"length({_digits(span)}) BETWEEN {low} AND {high}"


# Mod-97: the first four characters go last, letters count from 10, the number is 1 modulo 97.
_MOD97 = (
    "aggregate(split(concat(substring(y, 5), substring(y, 1, 4)), ''), 0, (r, c) -> "
    "if(c = '', r, if(c BETWEEN '0' AND '9', r * 10 + (ascii(c) - 48), r * 100 + (ascii(c) - 55)) % 97)) = 1"
)

# Lengths of account numbers by country (IBAN registry).
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_COUNTRY_LENGTH = "CASE " + " ".join(
    "WHEN substring(x, 1, 2) IN (" + ", ".join(f"'{c}'" for c in names.split()) + f") THEN {n}" for n, names in _IBAN_LENGTHS.items()
) + " END"
# Ends of words in `x` behind which mod-97 holds, longest first; `y` is the number without spaces.
_IBAN_ENDS = (
    "filter(sequence(length(x), 15, -1), e -> substring(x, e, 1) RLIKE '[A-Z0-9]' AND NOT substring(x, e + 1, 1) RLIKE '[A-Za-z0-9]' "
    f"AND exists(array(replace(substring(x, 1, e), ' ', '')), y -> if(length(y) BETWEEN 15 AND 34, {_MOD97}, false)))"
)
_IBAN_EXTENT = (
    f"element_at(transform(array({_IBAN_ENDS}), ends -> coalesce("
    f"get(filter(ends, e -> length(replace(substring(x, 1, e), ' ', '')) = {_COUNTRY_LENGTH}), 0), get(ends, 0))), 1)"
)

LOCAL = "[A-Za-z0-9._%+-]"
BASE = (
    Kind(
        "email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true",
        ("mail", "e-mail", "email", "contact", "write"), 0.9, 1.0,
    ),
    Kind(
        "ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]+\.[0-9]",
        "forall(split(x, '[.]'), p -> coalesce(try_cast(p AS decimal(38, 0)) <= 255, false))",
        ("ip", "address", "host", "server"), 0.7, 0.95,
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}",
        f"if({_count('x', 13, 19)}, luhn_check({_digits('x')}), false)",
        ("card", "visa", "credit", "payment"), 0.8, 1.0,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _count("x", 9, 15),
        ("phone", "tel", "call", "mobile"), 0.7, 0.95,
    ),
)
ADDED = (
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:[\x20]?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", "[A-Z]{2}[0-9]{2}",
        "true", ("iban", "account", "bank", "konto", "compte", "cuenta"), 0.9, 1.0, 0.5, _IBAN_EXTENT,
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]",
        "x NOT LIKE '000%' AND x NOT LIKE '666%' AND x NOT LIKE '9%' AND x NOT LIKE '%-00-%' AND x NOT LIKE '%-0000'",
        ("ssn", "social security"), 0.3, 0.9, 0.5,
    ),
)


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes a value once and uses it by name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sums_before(array: str, block: int = 256) -> str:
    """SQL for the sums before each entry of an int array, by way of blocks, so that an array of
    n entries takes n * (block + n / block ** 2) steps."""
    add = "0, (a, b) -> a + b"
    blocks = f"transform(sequence(0, (size({array}) - 1) div {block}), k -> aggregate(slice({array}, cast(k * {block} AS int) + 1, {block}), {add}))"
    starts = f"transform(blocks, (s, k) -> aggregate(slice(blocks, 1, k), {add}))"
    inside = f"aggregate(slice({array}, cast(i div {block} AS int) * {block} + 1, i % {block}), {add})"
    sums = f"transform({array}, (v, i) -> starts[cast(i div {block} AS int)] + {inside})"
    return _let("blocks", blocks, _let("starts", starts, sums))


def _extended(spans: str, ahead: str, extent: str, block: int = 256) -> str:
    """SQL for the spans that have an extent, from the left, without those that begin inside an earlier one.

    The spans that stay are gathered in blocks, so that many spans are not copied for each of them.
    """
    seen = f"zip_with({spans}, {ahead}, (s, a) -> named_struct('x', concat(s.x, a), 'start', s.start, 'end', s.end, 'n', s.n))"
    ended = (
        f"filter(transform({seen}, s -> named_struct('x', s.x, 'start', s.start, 'end', "
        f"s.start + element_at(transform(array(s.x), x -> {extent}), 1), 'n', s.n)), s -> s.end IS NOT NULL)"
    )
    kept = "array<struct<x:string,start:int,end:int,n:int>>"
    one = (
        f"aggregate(slice(ended, cast(k * {block} AS int) + 1, {block}), named_struct('last', r.last, 'held', cast(array() AS {kept})), (q, s) -> "
        "if(s.start < q.last, q, named_struct('last', s.end, 'held', array_append(q.held, s))))"
    )
    every = (
        f"aggregate(sequence(0, (size(ended) - 1) div {block}), named_struct('last', 0, 'blocks', cast(array() AS array<{kept}>)), (r, k) -> "
        f"{_let('q', one, 'named_struct(' + chr(39) + 'last' + chr(39) + ', q.last, ' + chr(39) + 'blocks' + chr(39) + ', array_append(r.blocks, q.held))')}, r -> flatten(r.blocks))"
    )
    return _let("ended", ended, f"if(size(ended) = 0, ended, {every})")


def spans_of(kind: Kind, text: str) -> Column:
    """Confirmed spans of a kind in the string column ``text``: array of kind, start, end, score.

    Between n matches there are n + 1 stretches of text; with their lengths and those of the
    matches each match starts at the sum of all lengths before it.
    """
    pattern, needs = f"r'{kind.pattern}'", f"r'{kind.needs}'"
    lengths = f"flatten(zip_with(slice(gaps, 1, size(found)), found, (g, m) -> array(length(g), length(m))))"
    spans = (
        "zip_with(found, sequence(1, size(found)), (m, n) -> "
        "named_struct('x', m, 'start', sums[2 * n - 1], 'end', sums[2 * n - 1] + length(m), 'n', n))"
    )
    if kind.extent:
        spans = _extended(spans, f"regexp_extract_all({text}, {pattern}, 1)", kind.extent)
    valid = f"filter({spans}, s -> exists(array(s.x), x -> {kind.valid}))"
    # What lies around a match is the end of the stretch before it and the start of the one behind it.
    behind = "substring(get(gaps, s.n), s.end - sums[2 * s.n - 1] - length(found[s.n - 1]) + 1, " + f"{CONTEXT})"
    near = f"lower(concat(right(get(gaps, s.n - 1), {CONTEXT}), ' ', {behind}))"
    words = "|".join(kind.words)
    scored = (
        f"transform({valid}, s -> named_struct('kind', '{kind.name}', 'start', s.start, 'end', s.end, "
        f"'score', if({near} RLIKE r'\\b(?:{words})\\b', {kind.with_word}D, {kind.score}D)))"
    )
    kept = f"filter({scored}, s -> s.score >= {kind.least}D)"
    none = f"cast(array() AS {SPANS})"
    placed = _let("gaps", f"split({text}, {pattern})", _let("sums", f"{_let('lengths', lengths, _sums_before('lengths'))}", kept))
    matched = _let("found", f"regexp_extract_all({text}, {pattern}, 0)", f"if(size(found) = 0, {none}, {placed})")
    return F.expr(f"if({text} RLIKE {needs}, {matched}, {none})")


def find(docs: DataFrame, text: str = "text", added: Sequence[Kind] = ADDED) -> DataFrame:
    """``docs`` with one array of spans per kind: ``email``, ``ip``, ``card``, ``phone`` and those of
    ``added``, each span with its kind, start, end and score."""
    prepare(docs.sparkSession)
    kinds = [*BASE, *added]
    rows = without(docs, ["_tw_text", *[k.name for k in kinds if k.name.lower() != text.lower()]])
    held = rows.withColumn("_tw_text", F.coalesce(quoted(text), F.lit("")))
    return held.select(*map(quoted, rows.columns), *[spans_of(k, "_tw_text").alias(k.name) for k in kinds])


def joined(names: Sequence[str]) -> Column:
    """``kind:start:end`` of the spans in these columns, kinds in the given order, by start."""
    every = F.concat(*[F.transform(n, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])) for n in names])
    return F.concat_ws(",", every)
