"""Readers that turn files, tables and broker records into DataFrames."""
