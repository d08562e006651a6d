"""The query workload, the tables it runs on, and the catalog of queries."""
