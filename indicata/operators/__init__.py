"""Operators Spark lacks as one call, built from DataFrame primitives."""
