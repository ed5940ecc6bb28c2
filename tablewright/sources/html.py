"""Stored HTML pages. Python only finds tags; every value is read by column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.hours import fix_hours_separators
from ..functions.labels import (
    nutrient_of,
    nutrient_parts,
    parse_dv,
    parse_nutrient,
    serving_size,
    servings_per_container,
    skip_include_na,
)
from ..functions.text import col, first_line, trim_ws

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_RUN = re.compile(r"[ \t\n\r\f]+")
_BREAKS = {"br", "div", "p", "li", "tr", "table"}


class _Tags(HTMLParser):
    """Elements in document order; each knows its parent, its last descendant and its text span."""

    def __init__(self, text: str) -> None:
        super().__init__()
        self.elements: list[dict] = []
        self.by_class: dict[str, list[dict]] = {}
        self.texts: list[str | None] = []
        self._open: list[int] = []
        self.feed(text)
        self.close()
        self._shut(0)

    def _shut(self, depth: int) -> None:
        for index in self._open[depth:]:
            self.elements[index].update(end=len(self.elements), text_end=len(self.texts))
        del self._open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in _BREAKS:
            self.texts.append(None)
        here, at = len(self.elements), len(self.texts)
        attrs = {k: v or "" for k, v in attrs}
        classes = attrs.get("class", "").split()
        parent = self._open[-1] if self._open else None
        element = {"tag": tag, "attrs": attrs, "classes": classes, "parent": parent, "at": here, "end": here + 1}
        element.update(text=at, text_end=at)
        self.elements.append(element)
        for name in dict.fromkeys(classes):
            self.by_class.setdefault(name, []).append(element)
        if tag not in _VOID:
            self._open.append(here)

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self.elements[self._open[depth]]["tag"] == tag:
                self._shut(depth)
                break
        if tag in _BREAKS:
            self.texts.append(None)

    def handle_data(self, data):
        self.texts.append(data)

    def under(self, outer: dict, test: Callable[[dict], bool]) -> list[dict]:
        return [e for e in self.elements[outer["at"] + 1 : outer["end"]] if test(e)]

    def inside(self, element: dict, test: Callable[[dict], bool]) -> bool:
        while element["parent"] is not None:
            element = self.elements[element["parent"]]
            if test(element):
                return True
        return False

    def shown(self, found: list[dict]) -> str | None:
        """Text of the first element as a browser lays it out: blanks collapsed, blocks on lines."""
        if not found:
            return None
        pieces = self.texts[found[0]["text"] : found[0]["text_end"]]
        return "".join("\n" if p is None else _RUN.sub(" ", p) for p in pieces)

    def joined(self, found: list[dict]) -> str | None:
        """Text of the first element with every piece stripped and nothing between pieces."""
        if not found:
            return None
        return "".join(p.strip() for p in self.texts[found[0]["text"] : found[0]["text_end"]] if p)


def _classed(name: str) -> Callable[[dict], bool]:
    return lambda e: name in e["classes"]


def _role(name: str) -> Callable[[dict], bool]:
    return lambda e: e["tag"] == "div" and e["attrs"].get("role") == name


def _hours(page: _Tags):
    for row in filter(_role("row"), page.elements):
        head, cell = page.under(row, _role("rowheader")), page.under(row, _role("cell"))
        yield "row", page.joined(head), page.joined(cell), [], None, None


def _menu(page: _Tags):
    hover, above = _classed(V.MENU_LINK), None
    for row in page.elements:
        if row["tag"] != "tr" or not page.inside(row, _classed(V.MENU_TABLE)):
            continue
        button = page.under(row, _role("button"))
        links = page.under(row, lambda e: e["tag"] == "a" and hover(e))
        images = page.under(links[0], lambda e: e["tag"] == "img") if links else []
        alts = [e["attrs"].get("alt") for e in images]
        labels = [e["attrs"]["id"] for e in links if e["attrs"].get("id", "").startswith(V.LABEL_LINK)]
        kind = row["attrs"].get("class", "")
        if V.MENU_GROUP_ROW in kind:
            above = page.shown(button)
        yield kind, page.shown(button), page.shown(links), alts, above, labels[0] if labels else None


def _label(page: _Tags):
    for part, name in V.LABEL_PARTS.items():
        found = page.by_class.get(name)
        if found:
            yield part, page.shown(found), None, [], None, None
    boxes = page.by_class.get(V.LABEL_CALORIES[0], [])
    calories = [size for box in boxes for size in page.under(box, _classed(V.LABEL_CALORIES[1]))]
    if calories:
        yield "calories", page.shown(calories), None, [], None, None
    bordered = page.by_class.get(V.LABEL_ROW, [])
    plain = page.by_class.get(V.LABEL_PLAIN_ROW, [])
    tables = page.by_class.get(V.LABEL_SECONDARY, [])
    inner = [row for row in bordered + plain if any(t["at"] < row["at"] < t["end"] for t in tables)]
    left, right = map(_classed, V.LABEL_SIDES)
    for section, rows in (("fact", bordered), ("secondary", sorted(inner, key=lambda row: row["at"]))):
        for row in rows:
            yield section, page.shown(page.under(row, left)), page.shown(page.under(row, right)), [], None, None


_READERS = {"hours": _hours, "menu": _menu, "label": _label}
_FIELDS = {"kind": "string", "first": "string", "second": "string", "alts": "array<string>", "above": "string", "link": "string"}
_ROW = pa.struct([(n, pa.string() if t == "string" else pa.list_(pa.string())) for n, t in _FIELDS.items()])


def _tag_rows(html: Column | str, page: str) -> Column:
    reader = _READERS[page]

    @F.arrow_udf(f"array<struct<{', '.join(f'{n} {t}' for n, t in _FIELDS.items())}>>")
    def rows(pages: pa.Array) -> pa.Array:
        def one(text: pa.Scalar) -> list[dict]:
            return [dict(zip(_FIELDS, row)) for row in reader(_Tags(text.as_py() or ""))]

        return pa.array([one(text) for text in pages], pa.list_(_ROW))

    return rows(col(html))


def hours_from_html(pages: DataFrame, key: str = "page_id", html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """``key, keep, pos, name, raw_hours, hours`` of hours pages; the first row is a heading."""
    rows = pages.select(key, *keep, F.posexplode(_tag_rows(html, "hours")).alias("pos", "_r"))
    named = rows.where("pos > 0 AND _r.first IS NOT NULL AND _r.second IS NOT NULL").select(
        key,
        *keep,
        "pos",
        trim_ws("_r.first", "python").alias("name"),
        trim_ws("_r.second", "python").alias("raw_hours"),
    )
    return named.withColumn("hours", fix_hours_separators("raw_hours"))


def menu_rows_from_html(pages: DataFrame, key: str = "page_id", html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """Category and item rows of menu pages in page order; other rows are left out.

    ``key, keep, pos, row_class, is_header, text, img_alts, link_id, above``. The text of an item is
    its first line; a category row without its button has null text. ``above`` is the text of the
    category row above, found in the same pass over the page; ``link_id`` names the item's label.
    """
    rows = pages.select(key, *keep, F.posexplode(_tag_rows(html, "menu")).alias("pos", "_r"))
    kind = F.col("_r.kind")
    header = F.contains(kind, F.lit(V.MENU_GROUP_ROW))
    primary, alternate = (F.contains(kind, F.lit(name)) for name in V.MENU_ITEM_ROWS)
    item = primary | alternate
    text = F.when(header, trim_ws("_r.first", "python")).otherwise(first_line("_r.second"))
    picked = rows.where(header | item).select(
        key,
        *keep,
        "pos",
        kind.alias("row_class"),
        header.alias("is_header"),
        text.alias("text"),
        F.col("_r.alts").alias("img_alts"),
        F.col("_r.link").alias("link_id"),
        trim_ws("_r.above", "python").alias("above"),
    )
    return picked.where("is_header OR (text IS NOT NULL AND text <> '')")


def menu_items_from_html(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    keep: Sequence[str] = (),
    auto_loaded: Column | None = None,
) -> DataFrame:
    """Item rows of menu pages with their ``category``: one pass over each page, no shuffle.

    The rules are those of ``items_from_menu_rows``, for pages that are rows of their own.
    """
    rows = menu_rows_from_html(pages, key, html, keep).where("NOT is_header")
    fallback = F.when(F.lit(False) if auto_loaded is None else auto_loaded, F.lit(V.UNCATEGORIZED))
    named = rows.withColumn("category", F.coalesce(F.nullif("above", F.lit("")), fallback)).drop("above", "is_header")
    return named.where(F.col("category").isNotNull())


def label_rows_from_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, section, pos, left_text, right_text`` of label pages."""
    rows = pages.select(key, F.posexplode(_tag_rows(html, "label")).alias("pos", "_r"))
    return rows.select(
        key,
        F.col("_r.kind").alias("section"),
        "pos",
        trim_ws("_r.first", "python").alias("left_text"),
        trim_ws("_r.second", "python").alias("right_text"),
    )


def label_facts(label_rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Parsed fact rows ``key, section, pos, name, amount, unit, daily_value_percent``."""
    facts = label_rows.where(
        F.col("section").isin("fact", "secondary")
        & F.col("left_text").isNotNull()
        & F.col("right_text").isNotNull()
        & ((F.col("section") == "secondary") | skip_include_na("left_text"))
    )
    parsed = facts.withColumn("_n", parse_nutrient("left_text"))
    return parsed.select(
        key,
        "section",
        "pos",
        F.col("_n.name").alias("name"),
        F.col("_n.amount").alias("amount"),
        F.col("_n.unit").alias("unit"),
        F.when(F.col("_n.matched"), parse_dv("right_text")).alias("daily_value_percent"),
    )


def _fact_map(rows: Column) -> Column:
    """Map of a page's fact rows; a name met twice keeps its last row."""
    names = F.array_distinct(F.transform(rows, lambda r: r["name"]))
    last = F.transform(
        names,
        lambda n: F.element_at(F.filter(rows, lambda r: r["name"].eqNullSafe(n)), -1)["value"],
    )
    return F.map_from_arrays(names, last)


def label_from_html(pages: DataFrame, key: str = "page_id", html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """One nutrition struct per label page, read inside the page's own row."""
    rows = pages.select(key, *keep, _tag_rows(html, "label").alias("_rows"))

    def text_of(part: str) -> Column:
        return trim_ws(F.get(F.filter("_rows", lambda r: r["kind"] == part), 0)["first"], "python")

    def fact_rows(section: str) -> Column:
        def keep(r: Column) -> Column:
            whole = (r["kind"] == section) & r["first"].isNotNull() & r["second"].isNotNull()
            return whole & skip_include_na(r["first"]) if section == "fact" else whole

        def split(r: Column) -> Column:
            return F.struct(nutrient_parts(r["first"]).alias("parts"), r["second"].alias("right"))

        def read(r: Column) -> Column:
            return F.struct(nutrient_of(r["parts"]).alias("n"), r["right"].alias("right"))

        def value(r: Column) -> Column:
            n = r["n"]
            daily = F.when(n["matched"], parse_dv(r["right"])).alias("daily_value_percent")
            return F.struct(n["name"].alias("name"), F.struct(n["amount"], n["unit"], daily).alias("value"))

        # Three passes, so that each step reads the one before instead of repeating it.
        found = F.filter("_rows", keep)
        return F.transform(F.transform(F.transform(found, split), read), value)

    parts = rows.select(
        key,
        *keep,
        text_of("name").alias("item_name"),
        text_of("serving").alias("_serving"),
        text_of("calories").alias("calories"),
        _fact_map(fact_rows("fact")).alias("nutrition_facts"),
        _fact_map(fact_rows("secondary")).alias("_secondary"),
        text_of("ingredients").alias("ingredients"),
        text_of("allergens").alias("allergens"),
    )
    serving = F.struct(
        servings_per_container("_serving").alias("servings_per_container"),
        serving_size("_serving").alias("serving_size"),
    )
    return parts.select(
        key,
        *keep,
        F.struct(
            "item_name",
            F.when(F.col("_serving").isNotNull(), serving).alias("serving_info"),
            "calories",
            "nutrition_facts",
            F.map_filter("_secondary", lambda name, _: ~F.map_contains_key("nutrition_facts", name)).alias(
                "secondary_nutrients"
            ),
            "ingredients",
            "allergens",
        ).alias("nutrition"),
    )


def links_from_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """List links of any page, ``key, pos, href, text``; plain enough for a built-in pattern."""
    whole, parts = r'<li><a href="[^"]*">[^<]*</a></li>', r'^<li><a href="([^"]*)">([^<]*)</a></li>$'
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(col(html), F.lit(whole), F.lit(0))).alias("pos", "_l"))
    return rows.select(key, "pos", F.regexp_extract("_l", parts, 1).alias("href"), F.regexp_extract("_l", parts, 2).alias("text"))
