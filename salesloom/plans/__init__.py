"""Operators put together: the daily load, and the registered queries with their check SQL."""
