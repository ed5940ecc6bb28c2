"""Dataflow steps over flat menu, nutrition, calendar and timetable tables."""
