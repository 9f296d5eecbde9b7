"""Derived tables over the driver's data and the catalog of named queries."""
