"""Marlstone: retrieval, event and text analytics written as PySpark DataFrame jobs."""
