"""Site-screening analytics and training-data preparation as Spark jobs."""
