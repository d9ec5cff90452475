"""Execution of iterative plans, command line and driver queries."""
