"""eventloom: event-catalogue analytics expressed as Spark DataFrame plans."""
