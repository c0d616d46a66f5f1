"""assayer: supply-chain evidence analytics expressed as Spark plans."""
