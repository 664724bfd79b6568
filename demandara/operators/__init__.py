"""Relational operators: joins, aggregates, windows, quality and inventory policy."""
