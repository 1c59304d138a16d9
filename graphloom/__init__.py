"""graphloom: code-graph and record-graph analytics as Spark plans."""
