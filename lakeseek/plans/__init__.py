"""The query language, the planner and the builders of search plans."""
