"""gridloom: three-level group quantization and corpus preparation on Spark."""
