"""The dataflows applied to the TPC-H-like tables, with the SQL each result must equal."""
