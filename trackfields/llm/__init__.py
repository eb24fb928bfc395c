"""Operators for large document collections. Nothing outside this subpackage imports it."""
