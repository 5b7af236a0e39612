"""Spark-native analytics for ordered event data.

Everything outside ``matchweave.llm`` covers interaction networks, sequence
matching, stat comparison and similarity; ``matchweave.llm`` holds operators
for preparing training corpora and nothing else in the package imports it.
"""
