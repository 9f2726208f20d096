"""Spark-first analytics over run ledgers, object inventories and snapshot stores."""
