"""Structured Streaming entry points.

The analyses read complete files, so nothing here is a new operator: the
same wave pipeline (S9) runs incrementally over a landing folder, each new
export file is processed once, with progress kept in a checkpoint.
"""
