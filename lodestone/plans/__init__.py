"""Query catalogues: each module maps query names to plans and, where SQL can say it, to oracle SQL."""
