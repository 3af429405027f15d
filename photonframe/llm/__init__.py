"""Training-data operators: tokenizing, filtering, mixing, searching, sharding and extraction.

Nothing outside this folder imports it.
"""
