"""Linked-entity surveillance analytics on Spark: lazy, schema-parametric DataFrame operators."""
