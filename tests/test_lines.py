"""Readers by line against readers of whole files, for any cut of the files into splits."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators.calendar import event_blocks, parse_events
from tablewright.sources import lines, menus


@pytest.fixture(params=[1 << 27, 700, 61, 17])
def splits(spark, request):
    """Bytes of a split: whole files, some lines, less than most lines."""
    settings = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def menu_text(dice, eol):
    out = ["    - orphan", "  Too early:", "    - lost"] if dice.random() < 0.5 else []
    for r in range(dice.randint(2, 4)):
        out.append(dice.choice(["Café Rouge - 8 am - 9 pm", "Bella", "X: y - closed"]) + str(r))
        out += ["    - before any category"] if dice.random() < 0.3 else []
        for c in range(dice.randint(0, 4)):
            out.append(f"  Cat {c}:")
            odd = ["    - ", "   -not", "", "  other text", "    \t- tabbed", "\t- a line of its own"]
            out += [dice.choices([f"    - méal {c} {n}", *odd], [12, 1, 1, 2, 2, 2, 0.3])[0] for n in range(dice.randint(0, 9))]
        out.append("")
    return eol.join(out) + dice.choice(["", eol])


def test_menu_rows(spark, tmp_path, splits):
    dice = random.Random(3)
    for n in range(3):
        (tmp_path / f"{n}.txt").write_text(menu_text(dice, ["\n", "\r\n", "\n"][n]), newline="")
    (tmp_path / "empty.txt").write_text("")
    read = lines.read_lines(spark, str(tmp_path))
    if splits < 100:
        assert read.select("snapshot_id", "split").distinct().count() > 10
    whole = menus.read_menu_text(spark, str(tmp_path))
    names = [c for c in whole.columns if c != "item_ord"]
    got = lines.read_menu_lines(spark, str(tmp_path)).select(*whole.columns)
    order = ["snapshot_id", "item_ord"]
    wanted = [tuple(r) for r in whole.orderBy(*order).select(*names).collect()]
    assert [tuple(r) for r in got.orderBy(*order).select(*names).collect()] == wanted and len(wanted) > 15
    assert got.schema["restaurant_ord"].dataType == whole.schema["restaurant_ord"].dataType


CALENDAR = (
    "BEGIN:VCALENDAR\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:A long talk\r\n  that goes\r\n\ton and on\r\nDTSTART:20240101T000000Z\r\nEND:VEVENT\r\n"
    "text between\r\nBEGIN:VEVENT\r\nSUMMARY:nested BEGIN:VEVENT here\r\nDESCRIPTION:é\\, x\r\n \r\n  y\r\nDTSTART:20240102\r\nEND:VEVENTtail BEGIN:VEVENTSUMMARY:one line DTSTART:20240103T000000ZEND:VEVENT\r\n"
    "BEGIN:VE\r\n VENT\r\nSUMMARY:folded mark\nDTSTART:20240104T000000Z\n\nEND:VEVEN\n T\r\nBEGIN:VEVENT\nSUMMARY:open until the end\n"
)


@pytest.mark.parametrize("dialect", ["strict", "lenient"])
def test_calendar_blocks(spark, tmp_path, splits, dialect):
    (tmp_path / "a.ics").write_text(CALENDAR, newline="")
    (tmp_path / "b.ics").write_text(" not folded\r\n" + CALENDAR.replace("\r", "") + "END:VEVENT", newline="")
    (tmp_path / "c.ics").write_text("", newline="")
    whole = event_blocks(menus.read_snapshot_texts(spark, str(tmp_path)), ["snapshot_id", "snapshot_ts"], dialect=dialect)
    got = lines.read_calendar_blocks(spark, str(tmp_path), dialect).select(*whole.columns)
    wanted = sorted(tuple(r) for r in whole.collect())
    assert sorted(tuple(r) for r in got.collect()) == wanted and len(wanted) >= 7
    if splits == 17:
        split = {r[0] for r in lines.read_lines(spark, str(tmp_path)).where(F.col("line").startswith(" ") | F.col("line").startswith("\t")).select("split").collect()}
        assert len(split) > 3  # folds lie in splits of their own


def test_events_of_split_calendars(spark, tmp_path):
    """Blocks by line go on into the same fields and events."""
    from tablewright.operators import calendar as C

    (tmp_path / "a.ics").write_text(CALENDAR, newline="")
    keep = ["snapshot_id"]
    whole = parse_events(menus.read_snapshot_texts(spark, str(tmp_path)).select("snapshot_id", "value"), keep)
    blocks = lines.read_calendar_blocks(spark, str(tmp_path)).drop("snapshot_ts")
    events = C.valid_events(C.event_projection(C.raw_fields(blocks, keep), keep))
    assert sorted(map(tuple, events.collect())) == sorted(map(tuple, whole.collect())) != []


def test_calendar_lines_are_read_once(spark, tmp_path):
    """Steps that read their input twice each do not add up, and events of one chunk are no pieces."""
    event = "BEGIN:VEVENT\r\nUID:{0}\r\nSUMMARY:talk\r\n  {0}\r\nEND:VEVENT\r\n"
    (tmp_path / "a.ics").write_text("BEGIN:VCALENDAR\r\n" + "".join(event.format(n) for n in range(300)) + "END:VCALENDAR\r\n", newline="")
    made = lines.read_calendar_blocks(spark, str(tmp_path))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 1
    whole = event_blocks(menus.read_snapshot_texts(spark, str(tmp_path)), ["snapshot_id", "snapshot_ts"])
    assert sorted(map(tuple, made.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
