"""Graphloom: knowledge-graph text and vector analytics on PySpark."""
