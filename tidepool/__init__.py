"""tidepool: activity search and analytics over files, documents and event logs, as Spark DataFrame programs."""
