"""Corpora from Parquet tables, wiki XML dumps and document folders."""
