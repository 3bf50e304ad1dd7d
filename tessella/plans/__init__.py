"""The graph model, projections, resolution, rules and registered queries."""
