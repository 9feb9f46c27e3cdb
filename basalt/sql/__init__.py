"""From GoogleSQL-flavoured text to Spark plans and table versions."""
