"""Query plans: fixtures, composed jobs and the registry of named queries."""
