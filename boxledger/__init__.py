"""boxledger: template-driven form ingestion expressed as Spark DataFrame jobs."""
