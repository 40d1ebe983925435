"""Column-expression builders. Everything here returns ``Column`` objects (or
column-name lists) so the work stays inside whole-stage codegen; no Python UDFs."""
