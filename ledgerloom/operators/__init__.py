"""The analytics questions, grouped by subject.

Every question is a function ``(tables, **parameters) -> DataFrame``.
"""
