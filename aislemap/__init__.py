"""Catalogue clustering and cluster evaluation as Spark DataFrame operators."""
