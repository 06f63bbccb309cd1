"""stowline: an item-ledger analytics engine on Spark DataFrames."""
