"""Training-data operators: dedup, decontamination, language ID, PII, mixing, WARC.

One module per operator, each with a general interface over DataFrames;
``queries`` holds the thin registered queries and their DuckDB SQL.
"""
