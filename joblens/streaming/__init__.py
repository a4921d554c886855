"""Structured Streaming forms of the operators.

State is kept per key, in arrival order across batches; within a batch the rows of a key are put in
order. Batches are batch jobs of the batch operators (`batches`), so a hot key is cut there, too.
"""
