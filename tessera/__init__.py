"""An analytics engine on Spark: a compact SQL dialect over declared, keyed tables, with vectors."""
