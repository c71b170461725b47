"""Business operations, one module per area."""
