"""Writers: nested JSON, text reports, lookup tables and calendar feeds."""
