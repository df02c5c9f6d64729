"""Spark jobs for auditing web sites, their search visibility and their event logs."""
