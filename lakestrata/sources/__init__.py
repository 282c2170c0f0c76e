"""Where entries come from and go to: file listings, parquet footers, stores, and a Spark data source."""
