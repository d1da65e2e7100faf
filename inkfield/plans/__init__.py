"""Plan helpers shared by operators: shared-folder materialisation, skew-safe joins and ranks, components."""
