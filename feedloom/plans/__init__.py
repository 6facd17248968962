"""Composite jobs: what a user of a feed panel or a maintenance task calls."""
