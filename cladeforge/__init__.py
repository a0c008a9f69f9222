"""Cladeforge: taxonomic classification and reference curation as Spark DataFrame plans."""

__version__ = "0.1.0"
