"""Reports and jobs: what a user calls."""
