"""Training-data operators.

Operators over corpus tables (documents, pages, benchmark, labels).  Nothing
outside this subpackage imports it; ``skyloom.llm.queries`` registers its
queries and their SQL.
"""
