"""Training-data operators: quality, tokenising, de-duplication, extraction, packing.

Nothing outside this folder imports it; :mod:`tracewell.llm.registry` names its queries.
"""
