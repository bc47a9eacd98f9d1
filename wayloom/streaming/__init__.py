"""Live operation: typed messages in, versioned state tables out."""
