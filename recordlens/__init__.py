"""Registers of public records as Spark tables: fold, measure, compare, audit."""
