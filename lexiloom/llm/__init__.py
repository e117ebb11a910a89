"""Training-data pipeline operators.

Nothing outside this subpackage imports it; its queries are registered through
``lexiloom.llm.queries``.
"""
