"""keyloom: keyspace-shaped analytics (sets, scored sets, streams, text, vectors) as PySpark DataFrame operators."""
