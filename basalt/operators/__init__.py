"""Relational operators Spark lacks or spells otherwise, as compositions of DataFrame operations."""
