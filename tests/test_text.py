import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.functions import text

WORDS = st.text(alphabet=st.sampled_from("aZ9 é½ﬁ²ñÇßİ한-_/'&.\t  　﻿ 𝐀"), max_size=12)


def normalized(value):
    return re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", value.lower())).strip(" ")


def slug(value):
    kept = re.sub(r"[^\w\s-]", "", value)
    return re.sub(r"[\s-]+", "_", kept).strip("_").lower()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WORDS, min_size=30, max_size=60))
def test_keys_agree_with_plain_python(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    rows = frame.select(
        "v", text.normalize_key("v").alias("key"), text.slugify("v").alias("slug"), text.trim_ws("v", "python").alias("trim")
    ).collect()
    for row in rows:
        assert row["key"] == normalized(row["v"])
        assert row["slug"] == slug(row["v"])
        assert row["trim"] == row["v"].strip()


def test_accents_become_separators(evaluate):
    out = evaluate([("Crème Brûlée ½ portion",), (" B&B's  Café ",)], "v string", lambda d: text.normalize_key("v"))
    assert out == ["cre me bru le e 1 2 portion", "b b s cafe"]


def test_js_trim_keeps_what_javascript_keeps(evaluate):
    out = evaluate([("﻿ a\u0085",), (" b ",)], "v string", lambda d: text.trim_ws("v"))
    assert out == ["a\u0085", "b"]


def test_split_name_hours(evaluate):
    def both(_):
        return F.concat_ws("|", *text.split_name_hours("v"))

    out = evaluate([("North Grill - 11 am - 9 pm",), (" No Hours ",), ("A -B - ",)], "v string", both)
    assert out == ["North Grill|11 am - 9 pm", "No Hours|", "A -B|"]


def test_line_kinds(evaluate):
    lines = ["", " \t", "Place - 1", "\tTab", "  Cat:", "  - odd:", "   Deep:", "    - Item", "    -Item", "  Cat: ", "  :"]
    out = evaluate([(v,) for v in lines], "v string", lambda d: text.classify_menu_line("v"))
    wanted = "blank blank restaurant restaurant category category other item other other other"
    assert out == wanted.split()


def test_lookup_keys(evaluate):
    out = evaluate([("a b/c/d",), ("none",)], "v string", lambda d: F.concat_ws("|", *text.split_lookup_key("v")))
    assert out == ["a b|c/d", ""]


def test_first_line(evaluate):
    assert evaluate([("\n Rice \n290 cal",)], "v string", lambda d: text.first_line("v")) == ["Rice "]
