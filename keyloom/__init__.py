"""keyloom: configuration-text and leaked-credential analytics as Spark jobs."""
