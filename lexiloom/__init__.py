"""Lexiloom: corpus analytics for PySpark.

Operators take and return DataFrames. ``lexiloom.operators`` holds the general
operators, ``lexiloom.functions`` column expressions, ``lexiloom.sources``
readers and writers, ``lexiloom.plans`` composed pipelines and the registered
queries, ``lexiloom.streaming`` the Structured Streaming forms. ``lexiloom.llm``
holds the training-text operators; nothing outside it imports it.
"""
