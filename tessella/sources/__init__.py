"""Source trees, their parser and facts, and graph documents."""
