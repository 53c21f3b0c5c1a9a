"""Scalar functions: Column expressions for data, plain functions for arguments."""
