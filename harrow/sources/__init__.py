"""Reading and writing pages: JSON, CSV, SQLite; the sinks never raise for a failed write."""
