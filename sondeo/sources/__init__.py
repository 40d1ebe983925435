"""Readers and writers: driver tables, survey exports, result sinks."""
