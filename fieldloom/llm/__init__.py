"""Training-data operators over corpora of documents and pages.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
