"""From a job description to fused Spark plans."""
