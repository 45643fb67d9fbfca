"""Fixture views over the driver's tables, the registered queries, and the SQL that checks them."""
