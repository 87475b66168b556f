"""Latent-score panel analytics, expressed as Spark DataFrame jobs."""
