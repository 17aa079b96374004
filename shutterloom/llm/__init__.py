"""Training-data operators: tokens, licences, near duplicates, URLs, language, quality.

Nothing else in the library imports this subpackage. `queries()` and
`oracle_sql()` of `shutterloom.llm.registry` list what it registers.
"""
