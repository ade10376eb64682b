"""Lineage analytics on Spark: record files, people and families, matching, ranking, quality rules, guarded edits."""
