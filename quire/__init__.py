"""Document-layout analytics and bilingual reading data on Spark."""
