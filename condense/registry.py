"""All queries of the library and their SQL."""

from condense import queries_lines, queries_repo, queries_reports, queries_texts

_PARTS = (queries_lines, queries_reports, queries_repo, queries_texts)
QUERIES = {name: function for part in _PARTS for name, function in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
