"""Relational operators: cleaning, merge, status rule, filters, grid, lookups, log folds."""
