"""Readers, the order-line adapter and writers."""
