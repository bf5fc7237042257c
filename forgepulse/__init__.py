"""Account-activity analytics as Spark jobs: events -> activities -> features -> verdicts."""
