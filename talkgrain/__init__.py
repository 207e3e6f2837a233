"""Analytics over support conversations and the knowledge that answers them, on Spark."""
