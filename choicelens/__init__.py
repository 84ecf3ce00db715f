"""Deceptive-design analytics over captured funnels, as Spark jobs."""
