"""cashlens: financial-ledger analytics as Spark DataFrame operators."""
