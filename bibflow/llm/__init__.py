"""Operators for large text-training pipelines.

One module per operator; ``queries`` holds the registered queries and their SQL.
Nothing outside this package imports it. Column names that begin with ``_llm_``, and
``_key`` where lines or passages are dropped, are the operators' own: input columns of such names do not come through.
"""
