"""gyeol: document analytics and evidence retrieval as Spark DataFrame plans."""
