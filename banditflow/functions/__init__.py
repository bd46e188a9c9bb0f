"""Column functions (JVM expressions) for the bandit math; see ``linalg``."""
