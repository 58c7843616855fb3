"""verdictflow: tool-call policy analytics and corpus preparation on Spark."""
