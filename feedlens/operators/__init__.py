"""DataFrame operators: lazy, distributed, without driver-side data."""
