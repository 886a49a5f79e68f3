"""Training-data operators: each module holds one operator over plain DataFrames; `entry` registers the queries.

Nothing outside this folder, `corpus_pipeline.py` and `tests/llm` uses it.
"""
