"""Tallyforge: settlement reconciliation and corpus preparation as Spark jobs."""
