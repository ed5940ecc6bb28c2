from pyspark.sql import functions as F

from tablewright.functions import labels
from tablewright.operators import menu as M
from tablewright.sources import html


def test_parse_nutrient(evaluate):
    rows = [("Total Fat 25g",), ("Trans Fat NA",), ("Dietary Fiber <1g",), ("Vitamin D 1.2.3mcg",), ("Iron 2",), ("Sugars",)]
    out = [tuple(r) for r in evaluate(rows, "v string", lambda d: labels.parse_nutrient("v"))]
    assert out == [
        ("Total Fat", 25.0, "g", True),
        ("Trans Fat", None, None, True),
        ("Dietary Fiber <1g", None, None, False),
        ("Vitamin D", None, "mcg", True),
        ("Iron", 2.0, None, True),
        ("Sugars", None, None, False),
    ]


def test_daily_value(evaluate):
    rows = [("32%",), ("%",), ("",), ("x%",), (" 4.5 % ",)]
    assert evaluate(rows, "v string", lambda d: labels.parse_dv("v")) == [32.0, None, None, None, 4.5]


def test_serving(evaluate):
    rows = [
        ("1 Servings per container\nServing Size2 oz (57g)",),
        ("3 oz portion\nServing Size 4 oz\nServing Size 1 cup",),
        ("Serving Size 4 oz\n3 oz portion",),
        ("some\n3 oz Portion \n5 slice",),
        ("x Servings per container\n2 Servings per container",),
        ("Serving Size\n2 cup",),
        ("plain",),
    ]
    sizes = evaluate(rows, "v string", lambda d: labels.serving_size("v"))
    assert sizes == ["2 oz (57g)", "1 cup", "4 oz", "3 oz Portion", None, "2 cup", None]
    counts = evaluate(rows, "v string", lambda d: labels.servings_per_container("v"))
    assert counts == [1, None, None, None, None, None, None]


HOURS = """<html><body><div role="row"><div role="rowheader">Place</div><div role="cell">Today</div></div>
<div role="row"><div role="rowheader"><a> North Grill </a></div><div role="cell"><p>7 am - 9 am</p><p>11 am - 2 pm</p></div><div role="cell">x</div></div>
<div role="row"><div role="rowheader">No Cell</div></div>
<div role="row"><div role="cell">only cell</div></div>
<div role="row"><div role="rowheader">A &amp; B</div><div role="cell">Noon - 3 pm</div></div></body></html>"""


def test_hours_page(spark):
    pages = spark.createDataFrame([(1, HOURS), (2, None), (3, "")], "page_id long, html string")
    rows = html.hours_from_html(pages).orderBy("pos").collect()
    assert [(r["pos"], r["name"], r["raw_hours"], r["hours"]) for r in rows] == [
        (1, "North Grill", "7 am - 9 am11 am - 2 pm", "7 am - 9 am, 11 am - 2 pm"),
        (4, "A & B", "Noon - 3 pm", "Noon - 3 pm"),
    ]
    crosswalk = spark.createDataFrame([("A & B", "A + B"), ("Old", "A + B")], "source_name string, target_name string")
    named = M.hours_by_name(html.hours_from_html(pages), crosswalk)
    assert {tuple(r) for r in named.select("restaurant", "hours").collect()} == {("North Grill", "7 am - 9 am, 11 am - 2 pm"), ("A + B", "Noon - 3 pm")}


def menu_page(rows):
    return f'<table class="table"><tbody>{"".join(rows)}</tbody></table>'


def item(name, alt="", kind="itemPrimaryRow"):
    return f'<tr class="cbo_nn_{kind}"><td><a class="x cbo_nn_itemHover"><span>{name}<br>info</span><img alt="{alt}"></a><img alt="halal"></td></tr>'


def group(name):
    return f'<tr class="cbo_nn_itemGroupRow"><td><div role="button">\n {name} </div></td></tr>'


def test_menu_pages(spark):
    rows = [item("Orphan"), group("Grill"), item("Burger", "Halal"), item("Fries", "vegan", "itemAlternateRow")]
    rows += ["<tr class='other'><td>skip</td></tr>", "<tr class='cbo_nn_itemPrimaryRow'><td>no link</td></tr>"]
    rows += ["<tr class='cbo_nn_itemGroupRow'><td>no button</td></tr>", item("Lost")]
    pages = spark.createDataFrame([(1, menu_page(rows)), (2, menu_page(rows))], "page_id long, html string")
    read = html.menu_rows_from_html(pages)
    items = M.items_from_menu_rows(read, auto_loaded=F.col("page_id") == 1)
    got = items.select("page_id", "category", "text", M.flag_from_alts("img_alts").alias("flag")).collect()
    one = sorted(tuple(r)[1:] for r in got if r["page_id"] == 1)
    two = sorted(tuple(r)[1:] for r in got if r["page_id"] == 2)
    assert one == [
        ("Grill", "Burger", True),
        ("Grill", "Fries", False),
        ("Uncategorized", "Lost", False),
        ("Uncategorized", "Orphan", False),
    ]
    assert two == [("Grill", "Burger", True), ("Grill", "Fries", False)]


def fact(kind, left, right):
    side = f'<div class="inline-div-left">{left}</div>' + (f'<div class="inline-div-right">{right}</div>' if right is not None else "")
    return f'<div class="cbo_nn_Label{kind}SubHeader">{side}</div>'


LABEL = (
    '<div class="cbo_nn_LabelHeader">Rice  Bowl</div>'
    '<div class="cbo_nn_LabelBottomBorderLabel"><div>2 Servings per container</div><div>Serving Size<span>3 oz</span></div></div>'
    '<div class="cbo_nn_LabelSubHeader">Calories <span class="font-22">120</span></div>'
    + fact("Bordered", "Total Fat 2g", "3%")
    + fact("Bordered", "Total Fat 4g", "5%")
    + fact("Bordered", "Include NA Added Sugars", "%")
    + fact("Bordered", "Broken 1g", None)
    + '<table class="cbo_nn_LabelSecondaryTable"><tr><td>'
    + fact("Bordered", "Calcium 40mg", "x%")
    + fact("NoBorder", "Potas. 60mg", "1%")
    + "</td></tr></table>"
)


def test_label_page(spark):
    pages = spark.createDataFrame([(1, LABEL), (2, "<p>none</p>")], "page_id long, html string")
    got = {r["page_id"]: r["nutrition"] for r in html.label_from_html(pages).collect()}
    label = got[1]
    assert label["item_name"] == "Rice Bowl" and label["calories"] == "120"
    assert tuple(label["serving_info"]) == (2, "3 oz")
    assert {k: tuple(v) for k, v in label["nutrition_facts"].items()} == {
        "Total Fat": (4.0, "g", 5.0),
        "Calcium": (40.0, "mg", None),
    }
    assert {k: tuple(v) for k, v in label["secondary_nutrients"].items()} == {"Potas.": (60.0, "mg", 1.0)}
    assert label["ingredients"] is None and label["allergens"] is None
    assert got[2]["serving_info"] is None and got[2]["nutrition_facts"] == {}
    facts = html.label_facts(html.label_rows_from_html(pages))
    assert facts.where("section = 'fact'").count() == 3 and facts.where("section = 'secondary'").count() == 2
