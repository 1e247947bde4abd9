"""Bindings of the operators to the driver's tables, and the registry of checked queries."""
