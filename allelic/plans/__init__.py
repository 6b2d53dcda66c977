"""The catalogue of queries: each a plan over the benchmark tables, with the same in SQL for checking."""
