"""wavetrail: radio-spectrum event analytics as Spark jobs."""
