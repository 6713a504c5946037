"""Column functions: missing-aware comparisons, arithmetic, crossings, numbers and dates."""
