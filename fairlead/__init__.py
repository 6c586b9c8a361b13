"""fairlead: batch sea routing and corpus preparation as Spark plans."""
