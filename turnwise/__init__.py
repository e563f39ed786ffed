"""Dialogue pairs, crowd votes, agreement and annotation rounds as Spark DataFrame jobs."""
