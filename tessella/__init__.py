"""Spark-native low-rank template search and the relational operators around it."""

__version__ = "0.1.0"

import os

# Spark's tasks are the parallelism: a linear algebra library with threads of its own in each of them gets in their way
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
