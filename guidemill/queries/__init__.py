"""Registered queries: name -> (Spark function, SQL for the check or None)."""
