"""DataFrame to DataFrame operators over bars, rules, signals and trades."""
