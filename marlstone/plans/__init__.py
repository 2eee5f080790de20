"""Queries of the operators over the driver's tables, with the SQL they are checked against."""
