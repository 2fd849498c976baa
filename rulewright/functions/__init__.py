"""Part of the rulewright library."""
