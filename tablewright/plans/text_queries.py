"""Text, hours, label and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import LABEL_LINK
from ..functions import hours as H
from ..functions import ics, labels, text, times
from ..operators import menu as M
from ..operators import nutrition as N
from ..sources import html
from .inputs import HOURS, hours_raw
from .menu_queries import CARRIED, PAGE
from .registry import Tables, query

# --- strings over whole documents -----------------------------------------------------------

# Decomposed letters that occur in the documents, written as letter and separator.
_ACCENTS = {"a": "äàáâã", "c": "ç", "e": "éèêë", "i": "íìîï", "n": "ñ", "o": "óòôöõ", "u": "üùúû"}


def _sql_normalized(value: str) -> str:
    out = f"lower({value})"
    for plain, marked in _ACCENTS.items():
        out = f"regexp_replace({out}, '[{marked}]', '{plain} ', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def _digest(value):
    return F.md5(value)


@query(f"SELECT doc_id, md5({_sql_normalized('text')}) AS key_md5, length({_sql_normalized('text')}) AS key_length FROM documents")
def normalize_key(t: Tables):
    key = t.documents.select("doc_id", text.normalize_key("text").alias("key"))
    return key.select("doc_id", _digest("key").alias("key_md5"), F.length("key").cast("long").alias("key_length"))


@query(r"""SELECT doc_id, md5(slug) AS slug_md5 FROM (
  SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s-]+', '_', 'g'), '_')) AS slug FROM documents)""")
def slugify(t: Tables):
    return t.documents.select("doc_id", _digest(text.slugify("text")).alias("slug_md5"))


@query("SELECT doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS js_md5, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS python_md5 FROM documents")
def trim_ws(t: Tables):
    padded = F.concat(F.lit(" 　 \t"), "text", F.lit(" \n  "))
    return t.documents.select(
        "doc_id", _digest(text.trim_ws(padded)).alias("js_md5"), _digest(text.trim_ws(padded, "python")).alias("python_md5")
    )


@query("SELECT doc_id, split_part(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1) AS first FROM documents")
def first_line(t: Tables):
    return t.documents.select("doc_id", text.first_line(F.concat(F.lit(" \n"), "text")).alias("first"))


@query("SELECT doc_id, contains(lower(text), 'the ') AS hit FROM documents")
def contains_ci(t: Tables):
    # The query is trimmed, so a blank is kept by asking for the word inside other text.
    return t.documents.select("doc_id", text.contains_ci(F.replace("text", F.lit(" "), F.lit("_")), " THE_ ").alias("hit"))


@query("SELECT doc_id, md5(replace(replace(text, chr(10) || ' ', ''), chr(10) || chr(9), '')) AS text_md5 FROM documents")
def ics_unfold(t: Tables):
    folded = F.regexp_replace("text", r"([^\n]{60})", "$1\r\n ")
    return t.documents.select("doc_id", _digest(ics.ics_unfold(folded)).alias("text_md5"))


@query(r"""SELECT doc_id, length(text) + length(text) - length(replace(replace(replace(text, ',', ''), ';', ''), '\', '')) AS escaped_length,
  md5(text) AS text_md5, md5(replace(text, ' ', chr(10))) AS newline_md5 FROM documents""")
def ics_escape_roundtrip(t: Tables):
    escaped = ics.ics_escape("text")
    coded = F.replace("text", F.lit(" "), F.lit(r"\N"))
    return t.documents.select(
        "doc_id",
        F.length(escaped).cast("long").alias("escaped_length"),
        _digest(ics.ics_unescape(escaped)).alias("text_md5"),
        _digest(ics.ics_unescape(coded)).alias("newline_md5"),
    )


# Documents with coded line breaks, dotted separators and a footer.
_DIRTY = r"replace(replace(text, chr(10), '\n'), '. ', ' . . ')"
_STRICT = r"regexp_replace(regexp_replace(replace(D, '\n', chr(10)), '\s*\.\s*\.\s*(\.\s*)?', chr(10) || chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_LENIENT = r"regexp_replace(regexp_replace(regexp_replace(replace(D, '\n', chr(10)), '\s*\.\s*\.\s*\.\s*', chr(10) || chr(10), 'g'), '\s*\.\s*\.\s*', chr(10) || chr(10), 'g'), '\n+', chr(10), 'g')"


def _dirty():
    coded = F.replace(F.replace("text", F.lit("\n"), F.lit(r"\n")), F.lit(". "), F.lit(" . . "))
    return F.concat(coded, F.lit(r"\n--- footer --- more"))


def _sql_cleaned(rule: str) -> str:
    return f"md5(trim({rule.replace('D', '(' + _DIRTY + chr(32) + '|| chr(92) || ' + chr(39) + 'n' + chr(39) + ')')}, ' ' || chr(10) || chr(9)))"


@query(f"SELECT doc_id, {_sql_cleaned(_STRICT)} AS text_md5 FROM documents")
def clean_description(t: Tables):
    return t.documents.select("doc_id", _digest(ics.clean_description(_dirty())).alias("text_md5"))


@query(f"SELECT doc_id, {_sql_cleaned(_LENIENT)} AS text_md5 FROM documents")
def clean_description_lenient(t: Tables):
    return t.documents.select("doc_id", _digest(ics.clean_description(_dirty(), "lenient")).alias("text_md5"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(html || CASE WHEN page_id % 3 = 0 THEN ' https://groups.example.org/rsvp?id=' || page_id ELSE '' END, 'https?://[a-zA-Z0-9_.-]+/rsvp\?id=[0-9]+', 0), ''), url) AS rsvp FROM pages")
def rsvp_url(t: Tables):
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" https://groups.example.org/rsvp?id="), "page_id")).otherwise("")
    return t.pages.select("page_id", ics.rsvp_url(F.concat("html", link), "url").alias("rsvp"))


@query("""SELECT p_partkey, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '11 am - 9 pm' ELSE 'Noon - 2 pm, 5 pm - 9 pm' END AS hours,
  lower(p_name) || ' ' || p_partkey || '/x/y' AS lookup_key, lower(p_name) || ' ' || p_partkey AS rest_key, 'x/y' AS item_key FROM part""")
def split_name_hours(t: Tables):
    key = F.col("p_partkey")
    tail = F.when(key % 3 == 0, " ").when(key % 3 == 1, " - 11 am - 9 pm").otherwise(" -  Noon - 2 pm, 5 pm - 9 pm ")
    name, hours = text.split_name_hours(F.concat(F.lit(" "), "p_name", tail))
    joined = text.lookup_key(F.lit("x/y"), F.concat_ws(" ", F.lower("p_name"), key.cast("string")))
    rest, item = text.split_lookup_key(joined)
    return t.part.select(
        "p_partkey",
        name.alias("name"),
        hours.alias("hours"),
        joined.alias("lookup_key"),
        rest.alias("rest_key"),
        item.alias("item_key"),
    )


# --- hours ----------------------------------------------------------------------------------


@query(f"WITH {HOURS} SELECT pos, raw_hours, hours FROM hours")
def fix_hours_separators(t: Tables):
    return hours_raw(t).select("pos", "raw_hours", H.fix_hours_separators("raw_hours").alias("hours"))


@query(f"""WITH {HOURS} SELECT h.pos, CAST(r.range_pos AS INTEGER) AS range_pos, r.start_min, r.end_min
FROM hours h LEFT JOIN hour_ranges r ON r.pos = h.pos""")
def parse_hours(t: Tables):
    ranges = H.parse_hours(H.fix_hours_separators("raw_hours"))
    rows = hours_raw(t).select("pos", F.posexplode_outer(ranges).alias("range_pos", "_r"))
    return rows.select("pos", "range_pos", "_r.start_min", "_r.end_min")


@query("""SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS start_min, CAST(CASE WHEN event_id % 5 = 0 THEN 1440 ELSE hour(ts) * 60 + minute(ts) END AS INTEGER) AS end_min FROM events""")
def parse_time_minutes(t: Tables):
    clock = F.date_format("ts", "h:mm a")
    end = F.when(F.col("event_id") % 5 == 0, " MIDNIGHT").otherwise(clock)
    return t.events.select(
        "event_id", H.parse_time_minutes(clock).alias("start_min"), H.parse_time_minutes(end, True).alias("end_min")
    )


# --- labels ---------------------------------------------------------------------------------

def _size():
    return F.col("p_size")


def _left():
    return (
        F.when(_size() % 6 == 0, F.format_string("Total Fat %dg", "p_size"))
        .when(_size() % 6 == 1, F.lit("Trans Fat NA"))
        .when(_size() % 6 == 2, F.format_string("Dietary Fiber <%dg", "p_size"))
        .when(_size() % 6 == 3, F.format_string("Vitamin D %d.2.3mcg", "p_size"))
        .when(_size() % 6 == 4, F.concat(F.lit("Sodium   "), F.col("p_retailprice").cast("string"), F.lit("mg")))
        .otherwise(F.format_string("Include NA %d Added Sugars 2.50", "p_size"))
    )


def _right():
    return F.when(_size() % 4 == 0, "%").when(_size() % 4 == 1, "x%").when(_size() % 4 == 2, "").otherwise(F.format_string("%d%%", "p_size"))
_FACT = """CASE p_size % 6 WHEN 0 THEN 'Total Fat' WHEN 1 THEN 'Trans Fat' WHEN 2 THEN 'Dietary Fiber <' || p_size || 'g'
    WHEN 3 THEN 'Vitamin D' WHEN 4 THEN 'Sodium' ELSE 'Include NA ' || p_size || ' Added Sugars' END AS name,
  CASE p_size % 6 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 4 THEN p_retailprice WHEN 5 THEN 2.5 END AS amount,
  CASE p_size % 6 WHEN 0 THEN 'g' WHEN 3 THEN 'mcg' WHEN 4 THEN 'mg' END AS unit"""
_DAILY = "CASE WHEN p_size % 4 = 3 THEN CAST(p_size AS DOUBLE) END"


@query(f"SELECT p_partkey, {_FACT}, p_size % 6 <> 2 AS matched, {_DAILY} AS daily FROM part")
def parse_nutrient(t: Tables):
    parsed = t.part.select("p_partkey", labels.parse_nutrient(_left()).alias("n"), labels.parse_dv(_right()).alias("daily"))
    return parsed.select("p_partkey", "n.*", "daily")


@query(f"SELECT p_partkey, {_FACT} FROM part WHERE p_size % 6 <> 5")
def skip_include_na(t: Tables):
    kept = t.part.select("p_partkey", _left().alias("left")).where(labels.skip_include_na("left"))
    return kept.select("p_partkey", labels.parse_nutrient("left").alias("n")).select("p_partkey", "n.name", "n.amount", "n.unit")


def _serving():
    return (
        F.when(_size() % 5 == 0, F.format_string("%d Servings per container\nServing Size%d oz (57g)", "p_size", "p_size"))
        .when(_size() % 5 == 1, F.format_string("%d oz portion\nServing Size first\nServing Size %d cup ", "p_size", "p_size"))
        .when(_size() % 5 == 2, F.format_string("about\n%d oz Portion\n3 slice\nSome Servings per container\n9 Servings per container", "p_size"))
        .when(_size() % 5 == 3, F.format_string("%d of them", "p_size"))
        .otherwise(F.format_string("%dServings per container\n %d fl oz ", "p_size", "p_size"))
    )


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 5 IN (0, 4) THEN p_size END AS INTEGER) AS servings,
  CASE p_size % 5 WHEN 0 THEN p_size || ' oz (57g)' WHEN 1 THEN p_size || ' cup' WHEN 2 THEN p_size || ' oz Portion' WHEN 4 THEN p_size || ' fl oz' END AS serving_size FROM part""")
def serving_info(t: Tables):
    return t.part.select(
        "p_partkey",
        labels.servings_per_container(_serving()).alias("servings"),
        labels.serving_size(_serving()).alias("serving_size"),
    )


# --- pages ----------------------------------------------------------------------------------


@query("""SELECT page_id, CAST(n - 1 AS INTEGER) AS pos, hrefs[n] AS href, texts[n] AS text FROM (
  SELECT page_id, unnest(generate_series(1, len(hrefs))) AS n, hrefs, texts FROM (
    SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
           regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS texts FROM pages))""")
def links_from_html(t: Tables):
    return html.links_from_html(t.pages)


def _pages(rows, key: str, head: str, tail: str):
    """One page per key from ``k, row`` markup; the key bounds the rows of a page."""
    listed = F.array_sort(F.collect_list(F.struct("k", "row")))
    body = F.array_join(F.transform(listed, lambda r: r["row"]), "\n")
    return rows.groupBy(key).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("html"))


def _menu_pages(t: Tables):
    key = F.col("p_partkey")
    header = F.format_string(
        '<tr class="cbo_nn_itemGroupRow"><td><div role="button"> %s </div></td></tr><tr class="spacer"><td><a class="cbo_nn_itemHover">no</a></td></tr>', "p_type"
    )
    image = F.when(_size() % 3 == 0, '<img alt="vegan"><img src="x.png" alt=" HALAL ">').otherwise("<img>")
    item = F.concat(
        F.when(key % 2 == 0, '<tr class="cbo_nn_itemPrimaryRow">').otherwise('<tr class="row cbo_nn_itemAlternateRow">'),
        F.format_string('<td><a class="link cbo_nn_itemHover" id="%s%d">\n  <span>%s</span><br>more &amp; more', F.when(key % 6 != 5, LABEL_LINK).otherwise("i"), "p_partkey", "p_name"),
        image,
        F.lit("</a></td></tr>"),
    )
    row = F.concat(F.when(key % 4 == 0, header).otherwise(""), item)
    rows = t.part.select(F.floor(key / PAGE).alias("page_id"), key.alias("k"), row.alias("row"))
    return _pages(rows, "page_id", '<html><body><table><tr class="itemPrimaryRow"></tr></table><table class="table wide"><tbody>', "</tbody></table>")


@query(f"""WITH {CARRIED}
SELECT page_id, k % 2 = 0 AS is_primary, p_name AS meal, coalesce(above, 'Uncategorized') AS category, (SELECT p_size % 3 = 0 FROM part WHERE p_partkey = k) AS is_halal
FROM carried WHERE above IS NOT NULL OR page_id % 2 = 0""")
def menu_rows_from_html(t: Tables):
    items = html.menu_items_from_html(_menu_pages(t), auto_loaded=F.col("page_id") % 2 == 0)
    return items.select(
        "page_id",
        F.contains("row_class", F.lit("itemPrimaryRow")).alias("is_primary"),
        F.col("text").alias("meal"),
        "category",
        M.flag_from_alts("img_alts").alias("is_halal"),
    )


def _hours_pages(t: Tables):
    row = F.format_string(
        '<div class="r" role="row"><div role="rowheader"><a href="#"> %s </a></div><div role="cell">%s</div><div role="cell">closed</div></div>',
        "name",
        F.replace("raw_hours", F.lit("pm5"), F.lit("pm<br>\n 5")),
    )
    rows = hours_raw(t).select(F.floor(F.col("pos") / 50).alias("page_id"), F.col("pos").alias("k"), row.alias("row"))
    head = '<div role="row"><div role="rowheader">Place</div><div role="cell">Today</div></div><div role="row"><p>none</p></div>'
    return _pages(rows, "page_id", head, "")


@query(f"WITH {HOURS} SELECT pos // 50 AS page_id, CAST(pos % 50 + 2 AS INTEGER) AS pos, name, raw_hours, hours FROM hours")
def hours_from_html(t: Tables):
    return html.hours_from_html(_hours_pages(t))


def _label_pages(t: Tables):
    def div(name: str, body) -> object:
        return F.concat(F.lit(f'<div class="x {name}">'), body, F.lit("</div>"))

    def fact(name: str, left, right) -> object:
        inner = F.concat(
            F.lit('<div class="inline-div-left"><b>'), left, F.lit('</b></div><div class="inline-div-right">'), right, F.lit("</div>")
        )
        return div(name, inner)

    page = F.concat(
        div("cbo_nn_LabelHeader", F.concat(F.lit(" "), "p_name", F.lit("\n"))),
        div("cbo_nn_LabelBottomBorderLabel", F.format_string("<div>%d Servings per container</div><div>Serving Size%d oz</div>", "p_size", "p_size")),
        div("cbo_nn_LabelSubHeader", F.format_string('Calories <span class="font-22">%d</span>', "p_size")),
        fact("cbo_nn_LabelBorderedSubHeader", F.replace(_left(), F.lit("<"), F.lit("&lt;")), _right()),
        fact("cbo_nn_LabelBorderedSubHeader", F.lit("Iron 1mg"), F.lit("4%")),
        F.lit('<table class="cbo_nn_LabelSecondaryTable"><tr><td>'),
        fact("cbo_nn_LabelNoBorderSubHeader", F.lit("Potas. 60mg"), F.lit("1%")),
        fact("cbo_nn_LabelNoBorderSubHeader", F.lit("Iron 9mg"), F.lit("9%")),
        F.lit("</td></tr></table>"),
        F.when(_size() % 7 != 0, div("cbo_nn_LabelIngredients", F.concat(F.lit("of "), "p_name"))).otherwise(""),
    )
    # Reading a page costs far more than moving the row it is made from.
    return t.part.repartition("p_partkey").select(F.col("p_partkey").alias("page_id"), page.alias("html"))


@query(f"""SELECT p_partkey AS page_id, 'fact' AS section, {_FACT}, CASE WHEN p_size % 6 <> 2 THEN {_DAILY} END AS daily_value_percent FROM part WHERE p_size % 6 <> 5
UNION ALL SELECT p_partkey, 'fact', 'Iron', 1, 'mg', 4 FROM part
UNION ALL SELECT p_partkey, 'secondary', 'Potas.', 60, 'mg', 1 FROM part
UNION ALL SELECT p_partkey, 'secondary', 'Iron', 9, 'mg', 9 FROM part""")
def label_facts_from_html(t: Tables):
    return html.label_facts(html.label_rows_from_html(_label_pages(t))).drop("pos")


@query("""SELECT p_partkey AS page_id, p_name AS item_name, p_size AS servings, p_size || ' oz' AS serving_size, CAST(p_size AS VARCHAR) AS calories,
  CASE WHEN p_size % 7 <> 0 THEN 'of ' || p_name END AS ingredients, CAST(NULL AS VARCHAR) AS allergens,
  CAST(CASE WHEN p_size % 6 = 5 THEN 1 ELSE 2 END AS INTEGER) AS n_facts, CAST(1 AS INTEGER) AS n_secondary, CAST(1 AS DOUBLE) AS iron, CAST(60 AS DOUBLE) AS potassium FROM part""")
def label_from_html(t: Tables):
    labels_read = html.label_from_html(_label_pages(t))
    n = "nutrition."
    return labels_read.select(
        "page_id",
        n + "item_name",
        F.col(n + "serving_info.servings_per_container").alias("servings"),
        n + "serving_info.serving_size",
        n + "calories",
        n + "ingredients",
        n + "allergens",
        F.size(n + "nutrition_facts").alias("n_facts"),
        F.size(n + "secondary_nutrients").alias("n_secondary"),
        F.try_element_at(n + "nutrition_facts", F.lit("Iron"))["amount"].alias("iron"),
        F.try_element_at(n + "secondary_nutrients", F.lit("Potas."))["amount"].alias("potassium"),
    )


@query(f"""WITH {CARRIED}
SELECT c.k, 'hall ' || page_id AS rest_key, lower(c.p_name) AS item_key, c.p_name AS item, coalesce(above, 'Uncategorized') AS category,
       p_size || ' oz' AS serving_size, CAST(p_size AS VARCHAR) AS calories, CASE WHEN p_size % 7 <> 0 THEN 'of ' || c.p_name END AS ingredients,
       CAST(CASE WHEN p_size % 6 = 5 THEN 1 ELSE 2 END AS INTEGER) AS n_facts
FROM carried c JOIN part ON p_partkey = k WHERE (above IS NOT NULL OR page_id % 2 = 0) AND k % 6 <> 5""")
def items_with_labels(t: Tables):
    pages = _menu_pages(t).withColumn("restaurant", F.concat(F.lit("Hall "), "page_id"))
    items = html.menu_items_from_html(pages, keep=["restaurant"], auto_loaded=F.col("page_id") % 2 == 0)
    labels_read = html.label_from_html(
        _label_pages(t).withColumn("link_id", F.concat(F.lit(LABEL_LINK), F.col("page_id").cast("string"))), key="link_id"
    )
    with_facts = N.attach_labels(items.withColumnRenamed("text", "meal"), labels_read).where("nutrition IS NOT NULL")
    key = F.replace("link_id", F.lit(LABEL_LINK)).cast("long").alias("k")
    shown = ["rest_key", "item_key", "item", "category", "serving_size", "calories", "ingredients"]
    return N.compact_nutrition(with_facts, ["link_id"]).select(key, *shown, F.size("facts").alias("n_facts"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d') AS day_text, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Safar ' || day(o_orderdate) || ', 1448 AH' END AS hijri FROM orders""")
def clean_time_and_hijri(t: Tables):
    raw = F.concat(F.date_format("o_orderdate", "dd"), F.lit(" (EDT)"))
    month = F.when(F.col("o_orderkey") % 4 != 0, "Safar")
    label = times.hijri_label(month, F.dayofmonth("o_orderdate").cast("string"), F.lit("1448"))
    return t.orders.select("o_orderkey", times.clean_time(raw).alias("day_text"), label.alias("hijri"))


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n, round_even(sum(CAST(l_quantity AS BIGINT)) / count(*), 1) AS mean FROM lineitem GROUP BY ALL")
def round1(t: Tables):
    counts = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), (F.sum(F.col("l_quantity").cast("long")) / F.count("*")).alias("m")
    )
    return counts.select("l_orderkey", "l_linenumber", "n", times.round1("m").alias("mean"))
