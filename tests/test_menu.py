import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators import menu as M
from tablewright.operators import nutrition as N
from tablewright.operators import search as S
from tablewright.operators import stats
from tablewright.sinks import writers as W
from tablewright.sources import lookups, menus

TEXT = """North Grill - 11 am - Midnight
  Grill:
    - Bean Burger
    - Bean Burger
  Sides:
    - Rice

Empty Spot - 7 am - 3 pm
No Hours Spot
    - Orphan Item
  Soup:
    - Lentil Soup
   note
    - Bread: dark
"""


def parse(spark, *texts):
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "snapshot_id int, value string")
    rows = menus.parse_menu_text(frame).orderBy("snapshot_id", "restaurant_ord", "category_ord", "item_ord").collect()
    return [(r["restaurant"], r["hours"], r["category"], r["meal"]) for r in rows]


def test_menu_text(spark):
    wanted = [
        ("North Grill", "11 am - Midnight", "Grill", "Bean Burger"),
        ("North Grill", "11 am - Midnight", "Grill", "Bean Burger"),
        ("North Grill", "11 am - Midnight", "Sides", "Rice"),
        ("No Hours Spot", "", "Soup", "Lentil Soup"),
        ("No Hours Spot", "", "Soup", "Bread: dark"),
    ]
    assert parse(spark, TEXT) == wanted
    assert parse(spark, TEXT.replace("\n", "\r\n")) == wanted
    assert parse(spark, "    - a\n  C:\n    - b\n" + TEXT) == wanted
    assert parse(spark, "", "\n \n", "Just a name") == []


def line_by_line(text):
    """The line rules, one line at a time."""
    out, rest, cat = [], None, None
    for line in text.split("\n"):
        if not line.strip():
            continue
        if not line.startswith(" "):
            name, sep, hours = line.partition(" - ")
            rest, cat = (name.strip(), hours.strip()), None
        elif line[:2] == "  " and line[2:3].strip() and line.endswith(":"):
            cat = line.strip()[:-1]
        elif line.strip().startswith("- ") and rest and cat is not None:
            out.append((*rest, cat, line.strip()[2:].strip()))
    return out


LINE = st.sampled_from(["", " ", "A - 1 - 2", "B", "\tC", "  X:", "  Y:", "  - Z:", "    - i", "    - j:", " - k", "   W:", "  V", "    -l"])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(LINE, max_size=14).map("\n".join), min_size=20, max_size=40))
def test_menu_text_agrees_with_line_rules(spark, texts):
    assert parse(spark, *texts) == [row for text in texts for row in line_by_line(text)]


def test_restaurants_with_counts(spark):
    frame = spark.createDataFrame([(1, TEXT)], "snapshot_id int, value string")
    rows = {r["restaurant"]: r for r in menus.parse_menu_restaurants(frame).collect()}
    assert set(rows) == {"North Grill", "No Hours Spot"}
    assert rows["North Grill"]["item_count"] == 3 and tuple(rows["North Grill"]["open_ranges"][0]) == (660, 1440)
    assert rows["No Hours Spot"]["open_ranges"] is None
    assert [c["name"] for c in rows["North Grill"]["categories"]] == ["Grill", "Sides"]


FAT = {"amount": 2.5, "unit": "g", "daily_value_percent": 3}
DOCUMENT = {
    "timestamp": "2024-01-01T00:00:00",
    "restaurants": [
        {
            "name": "Café Ünï & Co",
            "hours": "8 am - 9 am",
            "categories": [
                {
                    "name": "Hot",
                    "meals": [
                        {"name": "Soup", "is_halal": True, "nutrition": {"item_name": "", "calories": "90", "nutrition_facts": {"Fat": FAT, "Bad": {"amount": "1.2.3", "unit": None}}, "serving_info": {"serving_size": "1 cup"}}},
                        {"name": "SOUP!", "is_halal": True, "nutrition": {"item_name": "Soup two", "calories": "95"}},
                        {"name": "Bread"},
                    ],
                },
                {"name": "Cold", "meals": []},
            ],
        },
        {"hours": None, "categories": [{"name": "Hot", "meals": [{"name": "soup", "is_halal": True, "nutrition": {"item_name": "Third", "calories": "1"}}, {"name": "Tea", "is_halal": True, "nutrition": None}]}]},
        {"name": "Closed"},
    ],
}


def items(spark, folder):
    (folder / "menus.json").write_text(json.dumps(DOCUMENT, ensure_ascii=False))
    return menus.read_menu_json(spark, str(folder / "menus.json"))


def test_menu_json(spark, tmp_path):
    rows = items(spark, tmp_path).orderBy("item_ord").collect()
    assert [(r["restaurant"], r["hours"], r["meal"], r["is_halal"]) for r in rows] == [
        ("Café Ünï & Co", "8 am - 9 am", "Soup", True),
        ("Café Ünï & Co", "8 am - 9 am", "SOUP!", True),
        ("Café Ünï & Co", "8 am - 9 am", "Bread", False),
        ("Unknown", "Hours not available", "soup", True),
        ("Unknown", "Hours not available", "Tea", True),
    ]
    assert rows[0]["nutrition"]["nutrition_facts"]["Bad"]["amount"] is None
    assert rows[0]["nutrition"]["calories"] == "90"


def test_index_stats_and_rankings(spark, tmp_path):
    index = stats.restaurant_index(items(spark, tmp_path))
    rows = {r["restaurant"]: r for r in index.collect()}
    assert rows["Café Ünï & Co"]["safe_name"] == "café_ünï_co" and rows["Café Ünï & Co"]["total_items"] == 3
    assert rows["Unknown"]["halal_items"] == 2 and rows["Unknown"]["categories_count"] == 1
    row = stats.summary_stats(index).first()
    assert (row["total_restaurants"], row["total_items"], row["total_halal_items"]) == (2, 5, 4)
    assert row["average_items_per_restaurant"] == 2.5 and row["restaurants_with_halal"] == 2
    assert [r["restaurant"] for r in stats.top10_halal(index).collect()] == ["Café Ünï & Co", "Unknown"]
    empty = stats.summary_stats(index.where("false")).first()
    assert empty["average_items_per_restaurant"] is None and empty["total_items"] == 0


def test_index_of_documents_counts_what_is_listed(spark, tmp_path):
    listed = DOCUMENT["restaurants"] + [{"name": "Closed", "hours": "x", "categories": [{"name": "C"}, {"name": "C", "meals": [{"name": "M"}]}]}]
    (tmp_path / "d.json").write_text(json.dumps({"restaurants": listed}))
    documents = menus.read_menu_documents(spark, str(tmp_path / "d.json"))
    rows = stats.restaurant_index_documents(documents).orderBy("ord").collect()
    got = [(r["restaurant"], r["hours"], r["total_items"], r["halal_items"], r["categories_count"], r["ord"]) for r in rows]
    assert got == [
        ("Café Ünï & Co", "8 am - 9 am", 3, 2, 2, 0),
        ("Unknown", "Hours not available", 2, 2, 1, 1),
        ("Closed", "x", 1, 0, 2, 2),
    ]
    assert stats.listed_restaurants(documents).first()["total_restaurants"] == 4


def test_nutrition_lookup(spark, tmp_path):
    rows = items(spark, tmp_path)
    own, shared = N.build_nutrition_lookup(rows, ["item_ord"])
    by_rest = {(r["rest_key"], r["item_key"]): r["info"] for r in own.collect()}
    assert by_rest[("cafe u ni co", "soup")]["item"] == "Soup two"
    assert by_rest[("unknown", "soup")]["item"] == "Third"
    by_item = {r["item_key"]: r["info"] for r in shared.collect()}
    assert by_item["soup"]["item"] == "Soup" and by_item["soup"]["serving_size"] == "1 cup"
    assert by_item["soup"]["facts"]["Fat"]["amount"] == 2.5 and by_item["soup"]["secondary"] == {}
    assert N.lookup_count(rows).first()["n"] == 3
    probe = spark.createDataFrame([("CAFÉ ÜNÏ & CO", "Soup"), ("Other", " soup?"), ("Other", "Tea")], "restaurant string, meal string")
    keyed = N.nutrition_key(probe, own, shared)
    keys = {(r["restaurant"], r["meal"]): r["nutrition_key"] for r in keyed.collect()}
    assert keys == {("CAFÉ ÜNÏ & CO", "Soup"): "cafe u ni co/soup", ("Other", " soup?"): "*/soup", ("Other", "Tea"): None}
    more = spark.createDataFrame([("noslash",), ("*/none",), ("*/soup",)], "nutrition_key string")
    found = N.nutrition_by_key(more, own, shared).collect()
    assert [(r["nutrition_key"], r["info"]["item"]) for r in found] == [("*/soup", "Soup")]
    shown = {r["meal"]: r["info"] for r in N.item_info(probe, own, shared).collect()}
    assert shown["Soup"]["item"] == "Soup two" and shown["Tea"] is None
    W.write_nutrition_lookup(own, shared, str(tmp_path / "lookup"))
    again, _ = lookups.read_nutrition_lookup(spark, str(tmp_path / "lookup"))
    assert again.count() == 2


def test_search_and_open(spark):
    rows = spark.createDataFrame(
        [("Grill", "8 am - 9 am", "Hot", "Bean Burger"), ("Grill", "8 am - 9 am", "Side", "Rice"), ("Bean Bar", "", "Hot", "Tea")],
        "restaurant string, hours string, category string, meal string",
    )
    assert {r["meal"] for r in S.search_menu(rows, " BEAN ").collect()} == {"Bean Burger", "Tea"}
    assert S.search_menu(rows, "  ").count() == 3
    assert {tuple(r) for r in S.recount_after_filter(S.search_menu(rows, "side")).collect()} == {("Grill", 1)}
    now = F.lit("2024-07-01 12:30:00").cast("timestamp")
    assert {r["restaurant"] for r in S.filter_open_now(S.open_at(rows, now)).collect()} == {"Grill"}
    assert S.filter_restaurant(rows, None).count() == 3 and S.filter_restaurant(rows, "Bean Bar").count() == 1


def test_hours_join_is_exact_unless_normalized(spark):
    rows = spark.createDataFrame([("The PitchFork",), ("Sprout",)], "restaurant string")
    hours = spark.createDataFrame([("The Pitchfork", "8 am - 9 am"), ("Sprout", "Noon - 1 pm")], "restaurant string, hours string")
    assert {r["hours"] for r in M.attach_hours(rows, hours).collect()} == {"Hours not available", "Noon - 1 pm"}
    assert {r["hours"] for r in M.attach_hours(rows, hours, normalize=True).collect()} == {"8 am - 9 am", "Noon - 1 pm"}


def test_crosswalk(spark):
    table = lookups.crosswalk_dim(spark)
    assert table.count() == 27 and lookups.crosswalk_dim(spark, inverse=True).first()["source_name"] == table.first()["target_name"]


def test_nest_in_parts_loses_nothing(spark):
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cool").alias("restaurant"),
        F.concat(F.lit("c"), F.col("id") % 4).alias("category"),
        F.concat(F.lit("m"), "id").alias("meal"),
        (F.col("id") % 2 == 0).alias("is_halal"),
        F.col("id").alias("item_ord"),
    )
    nested = M.nest_menu(rows, block=50).collect()
    assert max(sum(len(c["meals"]) for c in r["categories"]) for r in nested) <= 50
    got = [(r["restaurant"], c["name"], m["name"]) for r in nested for c in r["categories"] for m in c["meals"]]
    assert sorted(got) == sorted((r["restaurant"], r["category"], r["meal"]) for r in rows.collect())
    for r in nested:
        for c in r["categories"]:
            numbers = [int(m["name"][1:]) for m in c["meals"]]
            assert numbers == sorted(numbers)


def test_text_report_round_trip(spark, tmp_path):
    rows = items(spark, tmp_path)
    hours = rows.select("restaurant", "hours").distinct()
    W.write_menu_text(M.menu_report_lines(rows, hours), str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text == (
        "Café Ünï & Co - 8 am - 9 am\n  Hot:\n    - Soup\n    - SOUP!\n    - Bread\n\n"
        "Unknown - Hours not available\n  Hot:\n    - soup\n    - Tea\n\n"
    )
    assert len(parse(spark, text)) == 5
    plain = M.menu_report_lines(rows).orderBy(*M.LINE_ORDER).first()
    assert plain["line"] == "Café Ünï & Co"


def test_json_writers(spark, tmp_path):
    rows = items(spark, tmp_path)
    index = stats.restaurant_index(rows, rows.select("restaurant", "hours").distinct())
    stamp = F.lit("2024-01-01T00:00:00")
    W.write_menu_json(rows, str(tmp_path / "nested"), stamp)
    columns = ["restaurant", "hours", "category", "meal", "is_halal", F.to_json("nutrition").alias("n")]
    back = menus.read_menu_json(spark, str(tmp_path / "nested"), multi_line=False)
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, rows.select(*columns).collect()))
    W.write_restaurant_parts(rows, index, str(tmp_path / "parts"), stamp)
    read = spark.read.json(str(tmp_path / "parts")).collect()
    assert {(r["name"], r["safe_name"], r["total_items"], r["halal_items"]) for r in read} == {
        ("Café Ünï & Co", "café_ünï_co", 3, 2),
        ("Unknown", "unknown", 2, 2),
    }
    W.write_index(index, str(tmp_path / "index"), stamp)
    assert spark.read.json(str(tmp_path / "index")).count() == 2
    W.write_summary(index, str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary" / "top_restaurants_by_items")).count() == 2


def test_one_slug_keeps_the_last_name(spark, tmp_path):
    rows = spark.createDataFrame(
        [("A-B", "c", "x", False, 1), ("A B", "c", "y", False, 2)],
        "restaurant string, category string, meal string, is_halal boolean, item_ord long",
    )
    index = stats.restaurant_index(rows).withColumn("hours", F.lit(""))
    W.write_restaurant_parts(rows, index, str(tmp_path / "parts"), F.lit("now"))
    assert [r["name"] for r in spark.read.json(str(tmp_path / "parts")).collect()] == ["A B"]


def test_folder_of_restaurants_and_index_file(spark, tmp_path):
    one = {"name": "R", "categories": [{"name": "C", "meals": [{"name": "M", "is_halal": True}]}], "total_items": 1}
    (tmp_path / "r.json").write_text(json.dumps(one))
    (tmp_path / "summary_stats.json").write_text("{}")
    entry = {"filename": "r.json", "safe_name": "r", "hours": "x", "total_items": 1, "halal_items": 1, "categories_count": 1}
    (tmp_path / "index.json").write_text(json.dumps({"total_restaurants": 2, "restaurants": {"R": entry, "A": entry}}))
    (tmp_path / "notes.txt").write_text("x")
    rows = menus.read_restaurant_jsons(spark, str(tmp_path)).collect()
    assert [(r["file_name"], r["restaurant"], r["meal"]) for r in rows] == [("r.json", "R", "M")]
    index = menus.read_index(spark, str(tmp_path / "index.json")).orderBy("ord").collect()
    assert [(r["restaurant"], r["total_items"]) for r in index] == [("R", 1), ("A", 1)]


def test_filters(spark):
    rows = spark.createDataFrame([("a", "Open until 9", "x"), ("b", "CLOSED", "There are no items available today")], "n string, status string, text string")
    assert [r["n"] for r in M.open_units_only(rows).collect()] == ["a"] and M.open_units_only(rows, skip_closed=False).count() == 2
    assert [r["n"] for r in M.drop_empty_panels(rows).collect()] == ["a"]
    merged = spark.createDataFrame([("r", "c", "m", 5), ("r", "d", "m", 6), ("r", "c", "m", 9)], "restaurant string, category string, meal string, item_ord long")
    assert {(r["category"], r["item_ord"], r["category_ord"]) for r in M.merge_menus(merged).collect()} == {("c", 5, 5), ("d", 6, 6), ("c", 9, 5)}
    assert M.distinct_meals(merged).count() == 2


@pytest.mark.parametrize("block", [1, 2, 7, 10_000])
def test_written_documents_do_not_depend_on_the_block(spark, tmp_path, block):
    rows = spark.range(40).select(
        F.concat(F.lit("R"), (F.col("id") % 3).cast("string")).alias("restaurant"),
        F.concat(F.lit("C"), (F.col("id") % 4).cast("string")).alias("category"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("meal"),
        (F.col("id") % 2 == 0).alias("is_halal"),
        F.col("id").alias("item_ord"),
    )
    path = str(tmp_path / "documents")
    W.write_menu_json(rows.withColumn("hours", F.lit("h")), path, F.lit("now"), block=block)
    back = menus.read_menu_json(spark, path, multi_line=False)
    assert {tuple(r) for r in back.select(*rows.columns).collect()} == {tuple(r) for r in rows.collect()}
    index = stats.restaurant_index_documents(menus.read_menu_documents(spark, path, multi_line=False))
    wanted = stats.restaurant_index(rows, order="item_ord")
    columns = ["restaurant", "ord", "total_items", "halal_items", "categories_count"]
    assert {tuple(r) for r in index.select(columns).collect()} == {tuple(r) for r in wanted.select(columns).collect()}
    listed = stats.listed_restaurants(menus.read_menu_documents(spark, path, multi_line=False)).first()
    assert listed["total_restaurants"] == 3


def test_report_of_a_read_document_has_each_title_once(spark, tmp_path):
    category = lambda name, *meals: {"name": name, "meals": [{"name": m} for m in meals]}
    document = {"restaurants": [{"name": n, "categories": [category("X", "a", "b"), category("Y", "c")]} for n in ("One", "Two")]}
    (tmp_path / "d.json").write_text(json.dumps(document))
    lines = M.menu_report_lines(menus.read_menu_json(spark, str(tmp_path / "d.json")))
    got = [r["line"] for r in lines.orderBy(*M.LINE_ORDER).collect()]
    one = ["  X:", "    - a", "    - b", "  Y:", "    - c", ""]
    assert got == ["One", *one, "Two", *one]


def test_restaurant_files_come_in_order_of_their_names(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name.upper(), "categories": [{"name": "C", "meals": [{"name": name}]}]}))
    (tmp_path / "index.json").write_text("{}")
    rows = menus.read_restaurant_jsons(spark, str(tmp_path)).orderBy("item_ord").collect()
    assert [r["restaurant"] for r in rows] == ["A", "B"]


def test_last_name_of_a_normalized_key_wins(spark):
    hours = spark.createDataFrame([("Cafe", "9 am", 1), ("CAFE!", "8 am", 2)], "restaurant string, hours string, pos int")
    rows = spark.createDataFrame([("café",)], "restaurant string")
    assert M.attach_hours(rows, hours.withColumn("restaurant", F.regexp_replace("restaurant", "Cafe", "Café")), normalize=True).count() == 1
    plain = spark.createDataFrame([("cafe",)], "restaurant string")
    assert M.attach_hours(plain, hours, normalize=True).first()["hours"] == "8 am"
