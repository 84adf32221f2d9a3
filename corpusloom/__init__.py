"""corpusloom: regulatory-text analytics as DataFrame-to-DataFrame operators on Apache Spark."""
