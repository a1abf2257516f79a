"""Job-queue lifecycle data on Spark: admission, dispatch, lifecycle, retention, search and metrics."""
