"""Source text as data: findings, waivers, fixes and reports as relations in Spark."""
