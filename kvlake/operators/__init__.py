"""Operators on an operation log: visibility, cursors, merging, compaction, recovery."""
