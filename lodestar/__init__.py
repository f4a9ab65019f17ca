"""Analytics over one wide table, and the text pipelines around it, as Spark jobs."""
