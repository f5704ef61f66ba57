"""gristmill: cleaning, vetting and rewriting of untrusted web text as Spark DataFrame operators."""
