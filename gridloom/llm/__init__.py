"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. ``registry`` lists its queries and the SQL for them.
"""
