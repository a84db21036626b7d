"""Readers; every row carries `ord`, its place in the input, where order has a meaning."""
