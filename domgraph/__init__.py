"""Execution-domain analytics over fact tables, on Spark."""
