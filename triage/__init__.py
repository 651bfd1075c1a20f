"""Review of captured web traffic and front-end artifacts as Spark tables."""
