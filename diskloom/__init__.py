"""diskloom: Spark-first analytics over collections of vintage disk images."""
