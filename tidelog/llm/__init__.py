"""Operators for large-scale training-data pipelines.

Self-contained: nothing else in the library imports this package, and it imports nothing from
the rest of the library.  Kernels work on Arrow buffers with numpy (no per-row Python functions);
everything that moves data is a DataFrame plan.
"""
