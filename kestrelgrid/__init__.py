"""kestrelgrid: code-intelligence and corpus analytics as Spark DataFrame plans."""
