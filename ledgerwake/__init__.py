"""Bank-transaction analytics as Spark jobs.

Every operator is a function from DataFrame to DataFrame built from Spark's own
expressions, so the same code runs on batch and on streaming frames.
"""
