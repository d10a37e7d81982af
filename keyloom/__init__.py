"""keyloom: keyed data structures as columnar tables on Spark."""
