"""Declared report jobs and the registered query set."""
