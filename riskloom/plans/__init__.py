"""DataFrame plans: staging, Silver, Gold, marts, serving aggregates, governed answers."""
