"""archivolt: evidence search, scorecard analytics and corpus preparation on Spark."""
