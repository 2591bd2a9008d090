"""Operators for training data: ten of them, their queries and the SQL that checks them."""
