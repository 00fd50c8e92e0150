"""Spark jobs for zone-level energy demand, and for corpus preparation in the separate subpackage ``llm``."""
