"""Registered queries, their reference SQL, and the complete analysis run."""
