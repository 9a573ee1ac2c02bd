"""Outlier models: fitted by Spark jobs, small when fitted, applied to Arrow batches."""
