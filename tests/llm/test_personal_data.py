import hashlib
import random
import re

from helpers import SCHEMA, clashing, frame
from pyspark.sql import functions as F

from tablewright.llm import personal_data


def luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [
        (kind, m.start(), m.end()) for kind, pattern, ok in kinds for m in re.finditer(pattern, text) if ok(m.group())
    ]


def card(dice, n):
    body = "".join(dice.choices("0123456789", k=n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def texts():
    dice = random.Random(9)
    bits = ["a@b.c", "_d@e.f", "x.y+z@mail-1.example.com", "@", "..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.0.0.1",
            "+1 (234) 555-0199", "+49 30", "+1)))", "é", "\U0001f600", "-", " ", "4111 1111 1111 1111", "12", "%", "\n",
            "99999999999999999999.1.1.1"]
    out = ["".join(dice.choices(bits, k=dice.randint(1, 12))) for _ in range(1500)]
    out += [f"card {card(dice, n)}, {card(dice, 16)[:8]} x" for n in range(11, 22) for _ in range(4)]
    out += ["a" * 60000, "1" * 60000, "1 " * 30000, "+1" + "(" * 30000, "a@" * 20000, "a.b" * 20000 + "@c.d", ". " * 9000]
    out += ["z@y.x " * 3000 + "é 1.2.3.4"]
    return out


def spans(rows, kinds):
    return [(s.kind, s.start, s.end) for kind in kinds for s in rows[kind]]


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string")
    kinds = [k.name for k in personal_data.BASE]
    for row in personal_data.find(docs).collect():
        assert spans(row, kinds) == base_spans(row.text), row.text[:200]


def test_checked_and_scored(spark):
    cases = [
        ("account DE89 3704 0044 0532 0130 00 ok", [("iban", 8, 35)]),
        ("GB82WEST12345698765432.", [("iban", 0, 22)]),
        ("GB82WEST12345698765431", []),
        ("my ssn is 123-45-6789", [("ssn", 10, 21)]),
        ("part number 123-45-6789", []),
        ("ssn 666-45-6789 and 1123-45-6789", []),
    ]
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "doc_id int, text string")
    rows = {r.doc_id: r for r in personal_data.find(docs).collect()}
    for n, (text, wanted) in enumerate(cases):
        assert spans(rows[n], ["iban", "ssn"]) == wanted, text
    near = spark.createDataFrame([("reply to my email a@b.c",), ("x " * 40 + "a@b.c",)], "text string")
    assert sorted(r.email[0].score for r in personal_data.find(near).collect()) == [0.9, 1.0]


def test_account_numbers_before_other_words(spark):
    spaced, plain, other = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    cases = [
        (f"{plain} Please pay", [(0, 22)]),
        (f"{spaced} BIC COBADEFF", [(0, 27)]),
        (f"{spaced} BIC COBADEFFXXX AND MORE CAPITALS 12345", [(0, 27)]),
        (f"{spaced} 2024", [(0, 27)]),
        (f"pay {spaced} 2024-05-01 I said", [(4, 31)]),
        (f"{spaced} {other} {plain} OK", [(0, 27), (28, 55), (56, 78)]),
        (f"{plain} {plain}\n{plain} A", [(0, 22), (23, 45), (46, 68)]),
        (f"NO9386011117947 X, MT84MALT011000012345MTLCAST001S Y", [(0, 15), (19, 50)]),
        (f"é\U0001f600 {spaced} É", [(3, 30)]),
        (f"{plain}Please", []),
        (f"{plain}7 Please", []),
        (f"X{plain} Please", []),
        ("DE89 3704 0044 0532 0130 01 BIC COBADEFF", []),
    ]
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "doc_id int, text string")
    rows = {r.doc_id: r for r in personal_data.find(docs).collect()}
    for n, (text, wanted) in enumerate(cases):
        assert [(s.start, s.end) for s in rows[n].iban] == wanted, text


def test_awkward_rows(spark):
    docs = clashing(frame(spark), ["email", "_tw_text", "spans"])
    found = personal_data.find(docs)
    assert found.count() == docs.count() and {"spans", "lang"} <= set(found.columns)
    assert found.where("text IS NULL").select(F.size("email")).first()[0] == 0
    assert personal_data.find(frame(spark, [], SCHEMA)).collect() == []


def test_digest_of_no_spans(spark):
    row = personal_data.find(frame(spark, [(1, None, None, None)])).select(personal_data.joined(["email", "ip"]).alias("j")).first()
    assert row.j == "" and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_time_grows_with_the_text(spark):
    """A text of nothing but spans, four times as long, takes about four times as long."""
    import time

    def seconds(size, unit):
        docs = frame(spark, [(1, unit * (size // len(unit)), "en", "a")], SCHEMA)
        best = []
        for _ in range(2):
            began = time.perf_counter()
            found = personal_data.find(docs).select(F.size("email").alias("e"), F.size("iban").alias("i")).first()
            best.append(time.perf_counter() - began)
        assert found.e + found.i == size // len(unit)
        return min(best)

    for unit in ("mail a@b.cc ", "iban GB82WEST12345698765432, "):
        seconds(12_000, unit)  # warm
        small, large = seconds(60_000, unit), seconds(240_000, unit)
        assert large < 7 * small + 0.5, (unit, small, large)


def test_context_is_found_next_to_many_spans(spark):
    text = "123-45-6789 " * 3 + "my ssn 123-45-6780 and " + "x" * 50 + " 123-45-6781. " + "y" * 50 + " 123-45-6782 is the social security number"
    found = personal_data.find(frame(spark, [(1, text, "en", "a")], SCHEMA)).first().ssn
    assert [text[s.start : s.end] for s in found] == ["123-45-6789", "123-45-6780", "123-45-6782"]
