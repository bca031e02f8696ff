"""Deferred expressions, the table wrapper and tidy selection: everything that is settled while a plan is built."""
