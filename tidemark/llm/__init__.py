"""Operators for large-scale training-data pipelines over text, pages and media.

Each module holds one operator; ``queries`` registers one query for each.
Nothing outside this subpackage imports it.
"""
