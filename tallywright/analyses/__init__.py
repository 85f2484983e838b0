"""Finance analyses on any table: each module has `build`, which gives the result, and `check`, which gives its findings."""
