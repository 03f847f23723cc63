"""Operators, a module each subject, with their queries."""
